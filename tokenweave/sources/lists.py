"""Word lists, aliases and the manifest that names them."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morphology import strip
from ..functions.unicode import nfc
from ..session import file_system

log = logging.getLogger(__name__)


def _csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The columns `names` of a CSV with a header, as text; a column the file lacks is null."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", mode="PERMISSIVE")
    return raw.select(*(F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names))


def _said(column: str):
    return strip(F.coalesce(column, F.lit("")))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """rank, lemma, gloss, kind, ref_count, ref_coverage in order of rank; rows with a blank lemma are left out.

    Quoted values may hold line breaks. A rank that is no number raises; other missing numbers are 0.
    """
    rows = _csv(spark, path, ["rank", "lemma", "gloss", "kind", "ref_count", "ref_coverage"]).where(_said("lemma") != "")
    number = lambda c, t: F.coalesce(F.nullif(_said(c), F.lit("")).cast(t), F.lit(0).cast(t)).alias(c)
    rank = F.coalesce(_said("rank").cast("int"), F.raise_error(F.concat(F.lit("no rank for "), "lemma")).cast("int"))
    return rows.select(rank.alias("rank"), nfc(_said("lemma")).alias("lemma"), _said("gloss").alias("gloss"), _said("kind").alias("kind"), number("ref_count", "bigint"), number("ref_coverage", "double")).orderBy("rank")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """variant, lemma, kind, note; rows with a blank variant or lemma are left out."""
    rows = _csv(spark, path, ["variant", "lemma", "kind", "note"]).where((_said("variant") != "") & (_said("lemma") != ""))
    return rows.select(nfc(_said("variant")).alias("variant"), nfc(_said("lemma")).alias("lemma"), _said("kind").alias("kind"), _said("note").alias("note"))


# The fields of a list's description, as the manifest and the reports name them.
@dataclass(frozen=True)
class ListMeta:
    id: str
    name: str
    short_name: str
    description: str
    entry_count: int
    reference_tokens: int
    source: str
    is_default: bool


class ListRegistry:
    """The lists of one folder, on any file system Spark reads, by its manifest.json. Lists are read once and then kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self._loaded: dict[str, tuple[ListMeta, DataFrame, DataFrame | None]] = {}

    def manifest(self) -> list[dict]:
        """Rows of the manifest that have an id; none, with a log line, if it is missing or can't be read."""
        try:
            text = self.spark.read.text(f"{self.folder}/manifest.json", wholetext=True).first()
            data = json.loads(text.value if text else "")
            return [row for row in data.get("lexicons", []) if row.get("id")]
        except (AnalysisException, ValueError, AttributeError) as problem:
            log.warning("no word lists: %s", problem)
            return []

    def _has(self, name: str | None) -> bool:
        if not name:
            return False
        fs, where = file_system(self.spark, f"{self.folder}/{name}")
        return fs.exists(where)

    def available(self) -> list[ListMeta]:
        """The default list first, then by name; lists whose file is missing are left out."""
        metas = []
        for row in self.manifest():
            if not self._has(row.get("entries_file")):
                log.warning("word list %s has no file", row["id"])
                continue
            name = row.get("name", row["id"])
            count = read_entries(self.spark, f"{self.folder}/{row['entries_file']}").count()
            metas.append(ListMeta(row["id"], name, row.get("short_name", name), row.get("description", ""), count, int(row.get("reference_tokens", 0)), row.get("source", ""), bool(row.get("default"))))
        return sorted(metas, key=lambda m: (not m.is_default, m.name))

    def default_id(self) -> str | None:
        metas = self.available()
        return metas[0].id if metas else None

    def load(self, list_id: str | None = None) -> tuple[ListMeta, DataFrame, DataFrame | None] | None:
        """(meta, entries, aliases or None) of a list, the default one without an id; None for an unknown id."""
        list_id = list_id or self.default_id()
        if list_id in self._loaded:
            return self._loaded[list_id]
        meta = next((m for m in self.available() if m.id == list_id), None)
        if meta is None:
            return None
        row = next(r for r in self.manifest() if r["id"] == list_id)
        aliases = row.get("aliases_file")
        some = self._has(aliases)
        found = (meta, read_entries(self.spark, f"{self.folder}/{row['entries_file']}").cache(), read_aliases(self.spark, f"{self.folder}/{aliases}").cache() if some else None)
        self._loaded[list_id] = found
        return found

    def clear(self) -> None:
        for _, entries, aliases in self._loaded.values():
            entries.unpersist()
            if aliases is not None:
                aliases.unpersist()
        self._loaded.clear()
