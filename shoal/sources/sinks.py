"""CSV export of records with their cluster number and name.

The projection is :func:`shoal.operators.report.export_frame`; this writes it
with a header, UTF-8 without a byte-order mark, one file per task (a cluster
writes in parallel; merge the parts downstream if one file is wanted).  Quotes are
doubled, spaces kept and empty texts written as nothing, so the texts read back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shoal.operators.report import EXPORT_HEADERS, export_frame


CSV_OPTIONS = {"header": True, "encoding": "UTF-8", "escape": '"', "emptyValue": "",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str, assignments: DataFrame | None = None,
               cards: DataFrame | None = None, include_cluster: bool = True,
               reference_headers: bool = True, mode: str = "overwrite") -> DataFrame:
    out = export_frame(df, assignments, cards, include_cluster,
                       EXPORT_HEADERS if reference_headers else None)
    out.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return out
