import duckdb
from helpers_llm import EDGE, edge_docs, empty_docs
from riskframe.llm import licenses

MIT = licenses.LICENSES["MIT"]


def scan(spark, rows):
    df = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r for r in df.collect()}


def test_equivalent_texts_match(spark):
    got = scan(spark, [
        (1, MIT), (2, "Copyright (c) 2020 Someone\n\n" + MIT.upper()), (3, MIT.replace("\n", " ").replace(",", " ;")),
        (4, MIT.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
        (5, "© 1999 X\nAll rights reserved.\n" + licenses.LICENSES["ISC"] + "\n"),
        (6, MIT + " and one word more"), (7, "(c) 2001\n"), (8, None)])
    assert [got[i].license_id for i in range(1, 9)] == ["MIT", "MIT", "MIT", "MIT", "ISC", None, None, None]


def test_every_known_text_finds_itself(spark):
    rows = list(enumerate(licenses.LICENSES.values()))
    got = scan(spark, rows)
    assert [got[i].license_id for i, _ in rows] == list(licenses.LICENSES)


def test_notice_lines(spark):
    got = scan(spark, [(1, "prose\nReleased under the MIT Licence\nmore\nlicensed under CC BY-NC 4.0\nLICENSED under cc-by-nc 4.0"),
                       (2, "the licensing of dogs"), (3, "prose")])
    assert (got[1].notices, got[1].license_lines) == ("CC-BY-NC-4.0,MIT", 3)
    assert (got[2].notices, got[2].license_lines) == ("", 1)
    assert (got[3].notices, got[3].license_lines) == ("", 0)


def test_edge_rows_and_empty_table(spark):
    got = licenses.license_scan(edge_docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in EDGE)
    assert licenses.license_scan(empty_docs(spark)).count() == 0


def test_plan_is_native(spark):
    plan = licenses.license_scan(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def titled_files():
    """(id or None, text) of licence files with headers of many kinds."""
    texts = licenses.LICENSES
    more = {i: t for t, i in reversed(list(licenses.more_texts().items()))}
    marked = lambda mark, t: "\n".join(f"{mark} {line}" for line in t.split("\n"))
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + MIT),
            ("MIT", "The MIT License (MIT)\n=====================\n\nCopyright © 2018 to present, X Ltd and contributors.\n\n" + MIT),
            ("MIT", marked("#", "Copyright (c) 2001 X\nCopyright The Y Authors\n\n" + MIT)),
            ("MIT", "/*\n" + marked(" *", "Copyright Someone <a@b.c>\n\n" + MIT) + "\n */"),
            ("ISC", "ISC License\n\nCopyright 2020, X\n\n" + texts["ISC"]),
            ("Zlib", "zlib License\n\n(C) 1995 X\n\n" + texts["Zlib"]),
            ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + texts["BSD-2-Clause"]),
            ("BSD-2-Clause", "Copyright X\n" + texts["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")),
            ("BSD-3-Clause", "BSD 3-Clause \"New\" or \"Revised\" License\n\nCopyright (c) X\n\n" + more["BSD-3-Clause"]),
            ("Unlicense", more["Unlicense"]), ("GPL-3.0", more["GPL-3.0"]), ("MPL-2.0", more["MPL-2.0"]),
            ("LGPL-2.1", more["LGPL-2.1"]), ("CC0-1.0", more["CC0-1.0"]), ("GPL-2.0", more["GPL-2.0"])]
    apache = next(t for t, i in licenses.more_texts().items() if i == "Apache-2.0" and "[yyyy]" in t)
    rows += [("Apache-2.0", apache), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2018 X Inc.")),
             ("Apache-2.0", apache[:apache.index("APPENDIX:")]),
             (None, "MIT License\n"), (None, "Copyright X\n" + MIT + " and one word more"), (None, "\n" * 100_000 + "Copyright X\n" * 500)]
    long = "".join(f"# Copyright (c) {1000 + n} Someone {n}\n" for n in range(900))
    return rows + [("MIT", long + MIT), ("ISC", "(c) 1999 Å\n" * 300 + "\n// © 2020 Z\n" + texts["ISC"]), (None, long)]


def test_licence_files_with_titles_comment_marks_and_bare_copyright_lines(spark):
    rows = titled_files()
    got = scan(spark, list(enumerate(t for _, t in rows)))
    assert [got[n].license_id for n in range(len(rows))] == [i for i, _ in rows]


def test_sql_knows_headers_and_all_texts(spark, tmp_path):
    rows = [(n, t) for n, (_, t) in enumerate(titled_files())] + [(100 + n, t) for n, (_, t, _) in enumerate(EDGE)]
    rows += [(200, "Copyright X\n\nprose under the MIT License."), (201, "License\n"), (202, "*\n" * 50 + "MIT\n" + MIT)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.toPandas().to_parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    cols = ["doc_id", "text_digest", "license_id", "notices", "license_lines"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({licenses.ORACLE})").fetchall()
    assert sorted(map(tuple, licenses.license_scan(df).select(*cols).collect()), key=str) == sorted(want, key=str)
