"""Writers. Results that are one ordered file are sorted and written by one task; they
are reports, small by nature. All take a path that Spark can write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_file(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).coalesce(1)


def write_ledger(ledger: DataFrame, path: str, limit: int = 1000) -> None:
    """The last `limit` rows as JSON lines, oldest first."""
    last = ledger.orderBy(F.desc("ts")).limit(limit)
    one_file(last, "ts").write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, *order: str | Column) -> None:
    one_file(df, *order).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, column: str, note: str | None = None) -> None:
    """One line for each row in order of column; with note, as column TAB note."""
    text = F.concat_ws("\t", column, note) if note else F.col(column)
    one_file(df, column).select(text.cast("string").alias("value")).write.mode("overwrite").text(path)


def write_screened(df: DataFrame, accepted: str, rejected: str, word: str = "word", reason: str = "reason") -> None:
    """Two side files from one screened list: words without a reason, and the others with it."""
    df = df.persist()
    write_lines(df.filter(F.col(reason).isNull()), accepted, word)
    write_lines(df.filter(F.col(reason).isNotNull()), rejected, word, reason)
    df.unpersist()


def checklist(battery: DataFrame) -> str:
    """A battery, one table for each stratum, as Markdown."""
    rows = battery.orderBy("stratum", "id").collect()
    out: list[str] = []
    last = None
    for r in rows:
        if r.stratum != last:
            out += ["", f"## {r.stratum}", "", "| id | probe | expected | result |", "|---|---|---|---|"]
            last = r.stratum
        out.append(f"| {r.id} | `{r.probe}` | {r.expected} | {r.result or ''} |")
    return "\n".join(out).strip() + "\n"
