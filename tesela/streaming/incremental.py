"""Running term statistics over a stream of documents or events (an extension, as the sources are batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions.text import words


def term_counts(documents: DataFrame, doc: str, text: str, at: str, late: str = "1 day") -> DataFrame:
    """Occurrences and documents of each term of a stream; a document that comes again within ``late`` counts once."""
    once = documents.withWatermark(at, late).dropDuplicatesWithinWatermark([doc])
    per_doc = once.select(doc, F.explode(words(F.col(text))).alias("termino"))
    return per_doc.groupBy("termino").agg(F.count(F.lit(1)).alias("apariciones"), F.approx_count_distinct(doc).alias("documentos"))


def windowed_counts(events: DataFrame, at: str, category: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each category in windows of event time; what is later than ``late`` is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), category).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("desde"), category, "n")


def context_unit_stream(units: DataFrame, doc: str, order: str, size: str, min_forms: int = 10) -> DataFrame:
    """doc, order, uc_idx: context units over a stream of units, the running sum of each document kept as state."""
    import pandas as pd

    kinds = dict(units.dtypes)

    def fold(key, batches, state):
        total, uc = state.get if state.exists else (0, 0)
        part = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows = []
        for o, s in zip(part[order], part[size]):
            rows.append((key[0], o, uc))
            total += int(s or 0)
            if total >= min_forms:
                total, uc = 0, uc + 1
        state.update((total, uc))
        yield pd.DataFrame(rows, columns=[doc, order, "uc_idx"])

    return units.groupBy(doc).applyInPandasWithState(fold, f"`{doc}` {kinds[doc]}, `{order}` {kinds[order]}, uc_idx int", "suma int, uc int", "append", "NoTimeout")
