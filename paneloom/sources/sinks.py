"""Writers of panels, attempts, fits and reports."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import tempfile
from collections.abc import Sequence
from html import escape
from io import StringIO
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_panel(panel: DataFrame, path: str, *, files: int = 8) -> None:
    """Zstandard Parquet, sites together and in order of site and date within each file."""
    ordered = panel.repartitionByRange(files, "site_id").sortWithinPartitions("site_id", "date_local")
    ordered.write.option("compression", "zstd").parquet(path)


def write_once(path: str | Path, payload: dict) -> None:
    """JSON with sorted keys by way of a temporary file on the driver's own disk; a different content under the name is an error."""
    path = Path(path)
    text = json.dumps(payload, sort_keys=True, indent=1) + "\n"
    if path.exists():
        if path.read_text() != text:
            raise FileExistsError(f"{path} holds something else")
        return
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def append_line(path: str | Path, record: dict) -> None:
    """Adds a line of JSON to a file on the driver's own disk."""
    with open(path, "a") as out:
        out.write(json.dumps(record, sort_keys=True) + "\n")
        out.flush()
        os.fsync(out.fileno())


def long_attempts(attempts: DataFrame, quantities: str = "quantities") -> DataFrame:
    """One row for each successful replicate, scope and quantity of a map of maps."""
    scopes = attempts.where("success").select("replicate", F.explode(quantities).alias("scope", "values"))
    return scopes.select("replicate", "scope", F.explode("values").alias("quantity", "value"))


def write_fit(fits: DataFrame, path: str, facts: dict) -> None:
    """Coefficients as Parquet, and facts that must match when they are read again."""
    fits.write.parquet(f"{path}/coefficients")
    spark = fits.sparkSession
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").coalesce(1).write.text(f"{path}/facts")


def read_fit(spark, path: str, facts: dict) -> DataFrame:
    found = json.loads(spark.read.text(f"{path}/facts").first()[0])
    if found != facts:
        raise ValueError(f"the fit in {path} is of {found}")
    return spark.read.parquet(f"{path}/coefficients")


def interval_text(point, lower, upper):
    """A column of points with their intervals, such as +1.20 [0.35, 2.10]."""
    return F.format_string("%+.2f [%.2f, %.2f]", point, lower, upper)


def signed_text(value, digits: int = 3):
    """A column of differences with their signs; four places for a small one, and the typographic minus."""
    short = F.format_string(f"%+.{digits}f", value)
    text = F.when((value != 0) & (F.abs(value) < 0.5 * 10.0**-digits), F.format_string(f"%+.{digits + 1}f", value)).otherwise(short)
    return F.replace(text, F.lit("-"), F.lit("\u2212"))


def _bounded(rows: DataFrame, columns: Sequence[str], most: int) -> list:
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return got


def _cell(v, labels: dict[str, str]) -> str:
    v = "" if v is None else "yes" if v is True else "no" if v is False else f"{v:,}" if isinstance(v, int) else f"{v:.4g}" if isinstance(v, float) else str(v)
    for old, new in labels.items():
        v = v.replace(old, new)
    return v


def markdown(rows: DataFrame, columns: Sequence[str] | None = None, *, most: int = 1000, title: str = "", note: str = "", labels: dict[str, str] | None = None) -> str:
    """A Markdown table of a report's rows, numbers to the right, with a title and a note if given.

    labels are texts to put in place of others. Longer results are an error.
    """
    columns = list(columns or rows.columns)
    got = _bounded(rows, columns, most)
    number = [bool(got) and all(isinstance(r[c], (int, float)) and not isinstance(r[c], bool) for r in got if r[c] is not None) for c in columns]
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(columns) + " |", "|" + "|".join("--:" if n else "---" for n in number) + "|"]
    lines += ["| " + " | ".join(_cell(r[c], labels or {}).replace("|", "\\|").replace("\n", " ") for c in columns) + " |" for r in got]
    return "\n".join(lines + (["", f"*Note:* {note}"] if note else [])) + "\n"


def html(rows: DataFrame, columns: Sequence[str] | None = None, *, caption: str, most: int = 1000, labels: dict[str, str] | None = None) -> str:
    """A captioned HTML table of a report's rows. Longer results are an error."""
    columns = list(columns or rows.columns)
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(_cell(r[c], labels or {}))}</td>" for c in columns) + "</tr>\n" for r in _bounded(rows, columns, most))
    return f"<table>\n<caption>{escape(caption)}</caption>\n<thead><tr>{head}</tr></thead>\n<tbody>\n{body}</tbody>\n</table>\n"


def write_report(rows: DataFrame, path: str | Path, columns: Sequence[str] | None = None, *, most: int = 1000) -> dict[str, object]:
    """A report as one CSV file with a header, and its line of the table manifest: name, rows, columns and digest."""
    columns = list(columns or rows.columns)
    text = StringIO(newline="")
    out = csv.writer(text, lineterminator="\n")
    out.writerow(columns)
    out.writerows([["" if v is None else v for v in r] for r in _bounded(rows, columns, most)])
    data = text.getvalue().encode()
    Path(path).write_bytes(data)
    return {"name": Path(path).name, "rows": data.count(b"\n") - 1, "columns": columns, "sha256": hashlib.sha256(data).hexdigest()}


def selected(rows: DataFrame, **equal: str) -> DataFrame:
    """Rows whose columns have exactly these values."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows
