"""DataFrame operators. Every operator is ``f(df, *, columns...) -> DataFrame``."""
