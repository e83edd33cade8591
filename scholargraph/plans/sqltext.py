"""SQL fragments shared by the DuckDB oracles (same folding and word rules)."""
from scholargraph.functions.text import ACCENTED, PLAIN


def fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def toks_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold_sql(x)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def values_sql(rows, cols) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"
