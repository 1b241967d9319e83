"""Runs as Parquet: immutable, one partition of facts per run, features beside them for ad-hoc SQL."""

from __future__ import annotations

import datetime
import logging
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.morphology import decode
from ..functions.vocab import DIMENSIONS
from ..session import file_system

log = logging.getLogger(__name__)
FACTS = ["filename", "chapter_index", "chapter_id", "chapter_title", "position", "type", "lemma", "form", "parse"]
FEATURES = [f"feat_{d}" for d in DIMENSIONS] + ["feat_status", "feat_deponent"]
RUNS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("filenames", T.ArrayType(T.StringType())),
    T.StructField("chapter_count", T.IntegerType()), T.StructField("token_count", T.LongType()), T.StructField("note", T.StringType()),
])


class RunStore:
    """A folder with runs/ and token_facts/run_id=.../; facts are read by partition and in reading order."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._cache: OrderedDict[str, DataFrame] = OrderedDict()

    def _fs(self, path: str):
        return file_system(self.spark, path)

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _folder(self, column: str, value: str) -> str:
        return f"{column}={self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}"

    def _facts_path(self, run_id: str) -> str:
        return f"{self.path}/token_facts/{self._folder('run_id', run_id)}"

    def _run_path(self, run_id: str) -> str:
        return f"{self.path}/runs/{self._folder('run', run_id)}"

    @staticmethod
    def with_features(facts: DataFrame, *keep: str) -> DataFrame:
        """facts with the feat_ columns, decoded from parse and type anew; a null label or type counts as empty."""
        known = facts.select(*keep, *FACTS).fillna("", ["parse", "type"])
        decoded = decode(known)
        return decoded.select(*keep, *FACTS, *(F.col(d).alias(f"feat_{d}") for d in DIMENSIONS), F.col("status").alias("feat_status"), F.col("is_deponent").cast("int").alias("feat_deponent"))

    def save(self, facts: DataFrame, model_id: str, filenames: list[str], note: str | None = None) -> str:
        """Writes a new run and gives its id. Facts come first: a run is listed only once it is whole."""
        run_id = uuid.uuid4().hex
        self.with_features(facts).sortWithinPartitions("chapter_index", "position").write.parquet(self._facts_path(run_id))
        counts = self.spark.read.parquet(self._facts_path(run_id)).agg(F.count_distinct("chapter_index").alias("c"), F.count("*").alias("n")).first()
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        row = self.spark.createDataFrame([(run_id, now, model_id, list(filenames), counts.c, counts.n, note)], RUNS)
        row.coalesce(1).write.mode("append").parquet(self._run_path(run_id))
        return run_id

    def add(self, runs: DataFrame, facts: DataFrame | None = None) -> None:
        """Runs made elsewhere, with ids of their own: all of them in one pass over their facts (run_id and FACTS), if given.

        Facts are decoded and written before their runs are listed. A run's facts may be any share of all.
        """
        if facts is not None:
            self.with_features(facts, "run_id").sortWithinPartitions("run_id", "chapter_index", "position").write.mode("append").partitionBy("run_id").parquet(f"{self.path}/token_facts")
        listed = runs.select(*(F.col(f.name).cast(f.dataType) for f in RUNS.fields), F.col("id").alias("run"))
        listed.write.mode("append").partitionBy("run").parquet(f"{self.path}/runs")

    def save_safely(self, *args, **kwargs) -> str | None:
        """save(), but a failure is logged and gives None."""
        try:
            return self.save(*args, **kwargs)
        except Exception:  # noqa: BLE001 - whatever goes wrong, the analysis must not be lost
            log.exception("the run was not saved")
            return None

    def runs(self) -> DataFrame:
        if not self._exists(f"{self.path}/runs"):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).option("recursiveFileLookup", "true").parquet(f"{self.path}/runs")

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self.runs().orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(max(limit, 1), 200))

    def count(self) -> int:
        return self.runs().count()

    def get(self, run_id: str):
        return self.runs().where(F.col("id") == run_id).first()

    def latest(self):
        return self.runs().orderBy(F.desc("created_at")).first()

    def facts(self, run_id: str) -> DataFrame | None:
        """The facts of a run in reading order, without stored features; None for an unknown run. The last `keep` stay cached."""
        if run_id in self._cache:
            self._cache.move_to_end(run_id)
            return self._cache[run_id]
        if not self._exists(self._facts_path(run_id)):
            return None
        df = self.spark.read.parquet(self._facts_path(run_id)).select(F.lit(run_id).alias("run_id"), *FACTS).orderBy("chapter_index", "position").cache()
        self._cache[run_id] = df
        while len(self._cache) > self.keep:
            self._cache.popitem(last=False)[1].unpersist()
        return df

    def delete(self, run_ids: list[str]) -> list[str]:
        """Removes runs and gives the ids that were there, each once, in the order asked for."""
        gone = []
        for run_id in dict.fromkeys(run_ids):
            fs, where = self._fs(self._run_path(run_id))
            if not fs.exists(where):
                continue
            fs.delete(where, True)
            self.forget(run_id)
            fs.delete(self._fs(self._facts_path(run_id))[1], True)
            gone.append(run_id)
        return gone

    def forget(self, run_id: str) -> None:
        if (df := self._cache.pop(run_id, None)) is not None:
            df.unpersist()

    def reindex(self, run_id: str) -> int:
        """Decodes the stored features of a run again; gives the number of its rows.

        The new copy is whole before the old one goes, so a lost executor costs neither.
        """
        at = self._facts_path(run_id)
        if not self._exists(at):
            return 0
        fresh, old = f"{self.path}/_fresh_{run_id}", f"{self.path}/_old_{run_id}"
        self.with_features(self.spark.read.parquet(at)).sortWithinPartitions("chapter_index", "position").write.mode("overwrite").parquet(fresh)
        fs, where = self._fs(at)
        fs.rename(where, self._fs(old)[1])
        fs.rename(self._fs(fresh)[1], where)
        fs.delete(self._fs(old)[1], True)
        self.forget(run_id)
        return self.spark.read.parquet(at).count()

    def table(self) -> DataFrame:
        """All facts with features, for SQL; columns that older runs lack are null."""
        df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/token_facts")
        return migrate(df)


def migrate(df: DataFrame) -> DataFrame:
    """df with the feature columns it lacks, as null."""
    return df.select("*", *(F.lit(None).cast("int" if c == "feat_deponent" else "string").alias(c) for c in FEATURES if c not in df.columns))
