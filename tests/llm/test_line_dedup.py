import random

from helpers_llm import EDGE, edge_docs, empty_docs
from riskframe.llm import line_dedup


def dropped(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: list(r.dropped) for r in line_dedup.line_templates(df, **options).collect()}


def test_recurring_templates_with_fields(spark):
    rows = [(i, f"{chr(97 + i) * 3} own {chr(97 + i) * 2} line {chr(97 + i)}\nVisited {i} times by {i * 3} people from 10.0.0.{i}\n\nend {i}") for i in range(5)]
    got = dropped(spark, rows, min_docs=3)
    assert got == {0: []} | {i: [1, 3] for i in range(1, 5)}          # the first of each template stays
    assert dropped(spark, rows[:2], min_docs=3) == {0: [], 1: []}


def test_similar_lines_without_digits_join_one_template(spark):
    base = "please sign in with your account name to read the rest of page".split()
    rows = []
    for i, w in enumerate(("red", "blue", "green")):
        line = list(base)
        line[6] = w
        rows.append((i, " ".join(line)))
    assert dropped(spark, rows) == {0: [], 1: [0], 2: [0]}
    far = [(i, " ".join(["please", "sign", "in"] + [f"{c}{w}" for w in base[3:]])) for i, c in enumerate("abc")]
    assert dropped(spark, far) == {0: [], 1: [], 2: []}


def test_lines_of_one_document_count_once(spark):
    line = "please sign in with your account {} to read the rest of page"
    rows = [(1, "\n".join(line.format(w) for w in ("name", "mail", "phone", "key"))), (2, line.format("name"))]
    assert dropped(spark, rows, min_docs=3) == {1: [], 2: []}
    assert dropped(spark, rows, min_docs=2) == {1: [1, 2, 3], 2: [0]}


def test_leaf_matches_comparison_with_every_template():
    rng = random.Random(6)
    for similarity in (0.5, 0.8, 1.0):
        leaf, plain = line_dedup.Leaf(similarity), []
        for _ in range(400):
            tokens = [rng.choice("ab") for _ in range(9)]
            off = [(sum(x != y or x == line_dedup.FIELD for x, y in zip(t, tokens)), i) for i, t in enumerate(plain)]
            best = min(off, default=(99, 0))
            if best[0] <= int(9 * (1 - similarity) + 1e-9):
                want = best[1]
                plain[want] = [x if x == y else line_dedup.FIELD for x, y in zip(plain[want], tokens)]
            else:
                want = len(plain)
                plain.append(tokens)
            assert leaf.add(list(tokens)) == want
        assert leaf.templates == plain


def test_bounded_table_gives_the_same(spark, monkeypatch):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(("sun", "moon", "tree", "lake")) for _ in range(8)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(5))) for i in range(40)]
    want = dropped(spark, rows)
    monkeypatch.setattr(line_dedup, "HOLD_CHARS", 500)
    assert dropped(spark, rows) == want


def test_edge_rows_drop_lines_and_empty_table(spark):
    got = line_dedup.line_templates(edge_docs(spark), min_docs=2).collect()
    assert len(got) == len(EDGE) and all(r.n_lines >= 1 and r.n_dropped == len(r.dropped) for r in got)
    docs = edge_docs(spark)
    clean = line_dedup.drop_lines(docs)
    assert clean.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in clean.collect()}
    assert (5, "a b  c") in texts and (9, "") in texts and (None, "") in texts
    assert (3, None) in texts and (14, "x" * 5000) in texts
    assert clean.count() == len(EDGE) - 1                    # the repeated row
    assert line_dedup.line_templates(empty_docs(spark)).count() == 0


def test_query_drops_a_passage_of_two_documents(spark, tmp_path):
    from riskframe.llm.queries import op7_line_dedup

    passage = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    rows = [(1, "own words here\n" + passage), (2, passage + "\nsome other end"), (3, "nothing of it")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.dropped for r in op7_line_dedup(spark, str(tmp_path)).collect()} == {1: "", 2: "0", 3: ""}


def brute(rows, min_docs=2):
    """The whole operator on lists: every line against every template."""
    miss = lambda n: int(n * 0.2 + 1e-9)
    lines = {line_dedup.mask(x) for _, t in rows for x in (t or "").split("\n")} - {""}
    leaves, template = {}, {}
    for line in sorted(lines, key=lambda x: x.encode()):
        tokens = line.split(" ")
        leaf = leaves.setdefault((len(tokens), *tokens[:3]), [])
        off = [(sum(x != y or x == "<*>" for x, y in zip(t, tokens)), i) for i, (t, _) in enumerate(leaf)]
        best = min(off, default=(1 << 30, 0))
        if best[0] <= miss(len(tokens)):
            t, name = leaf[best[1]]
            leaf[best[1]] = ([x if x == y else "<*>" for x, y in zip(t, tokens)], name)
        else:
            name = line
            leaf.append((tokens, name))
        template[line] = name
    held = {}
    for doc, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if line_dedup.mask(x):
                held.setdefault(template[line_dedup.mask(x)], []).append((doc, t, i))
    out = {r: [] for r in rows}
    for at in held.values():
        if len({t for _, t, _ in at}) >= min_docs:
            first = min(at, key=lambda r: (r[0] is None, r[0]))[0]
            # one document a doc_id in these tables: the smallest line of it stays
            stays = min((r for r in at if r[0] == first), key=lambda r: r[2])
            for r in set(at) - {stays}:
                out[r[:2]].append(r[2])
    return sorted(((d, sorted(v)) for (d, _), v in out.items()), key=str)


def test_whole_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(5)
    got = sorted(((r.doc_id, list(r.dropped)) for r in line_dedup.line_templates(docs).collect()), key=str)
    want = brute([tuple(r) for r in docs.collect()])
    assert got == want and sum(len(d) for _, d in got) > 50


def test_copies_alone_drop_nothing(spark):
    page = "\n".join(f"line {chr(97 + i) * 4} of the only page with words {chr(98 + i)}" for i in range(6))
    rows = [(i, page) for i in range(8)] + [(3, page), (None, page)]
    assert all(v == [] for v in dropped(spark, rows).values())
    # a line that another text shares stays in the first document only
    rows += [(20, "another start of it\n" + page.split("\n")[2])] * 2 + [(21, "another start of it\n" + page.split("\n")[2])]
    got = dropped(spark, rows)
    assert got == {0: []} | {i: [2] for i in [*range(1, 8), None]} | {20: [1], 21: [1]}


def test_few_texts_pass_at_a_time(spark):
    import pyarrow as pa
    import pytest
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    with line_dedup._few_rows(spark):
        got = [r.n for r in spark.range(0, 2000, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 2000 and max(got) <= line_dedup.BATCH_ROWS
    with pytest.raises(ValueError), line_dedup._few_rows(spark):
        raise ValueError
    assert spark.conf.get(name) == before
