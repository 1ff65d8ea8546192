"""Sinks: documents, metadata, training sets, history, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.metadata import collisions


def documents(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Spark's commit makes a write whole or nothing."""
    getattr(df.write.mode("overwrite"), form)(path)


def new_documents(df: DataFrame, held: DataFrame, path: str) -> DataFrame:
    """Appends documents of new uuids; returns those whose uuid is held with other content, which aren't written."""
    fresh, clash = collisions(held, df)
    fresh.write.mode("append").parquet(path)
    return clash


def metadata(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def training_sets(sets: dict[str, DataFrame], path: str, suffix: str = "") -> None:
    for name, df in sets.items():
        if not (suffix and name.endswith(suffix)):
            df.write.mode("overwrite").json(f"{path}/{name}{suffix}")


def history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def log(df: DataFrame, path: str) -> None:
    """Calls of a judge: stage, time, prompt, response."""
    df.write.mode("append").partitionBy("stage").json(path)


def report(statistics: DataFrame, title: str) -> str:
    """A Markdown table of a small table of statistics."""
    names = statistics.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " - |" * len(names)]
    lines += ["| " + " | ".join(str(v) for v in row) + " |" for row in statistics.toLocalIterator()]
    return "\n".join(lines) + "\n"


def previews(chunks: DataFrame, size: int = 200) -> DataFrame:
    return chunks.select("doc_uuid", "pos", F.substring("content", 1, size).alias("preview"), F.length("content").alias("size"))


def evaluation(df: DataFrame, path: str) -> None:
    """The values of an evaluation as JSON, one object a line; their table is small."""
    df.coalesce(1).write.mode("overwrite").json(path)
