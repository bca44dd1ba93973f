"""Paid model calls: which ones are made, in order, and one call for each run that may make one.

Budgets are counted before anything is called: admitted() tells by windows what going through the calls one after the other would
tell. The call itself is a table function with a partition for each run; what a model answers is checked before it is a row."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions import fixed
from ..functions.times import korea_day, korea_month
from .control import kst_hour
from .issues import json_array

CALL_MICRO_USD = 15_000
KNOWN, TITLE = 40, 40  # titles that candidates are held against; characters of a new title


def admitted(
    calls: DataFrame, by: tuple[str, ...] = (), general: int = fixed.DAILY_CALLS - fixed.RESERVED_CALLS, total: int = fixed.DAILY_CALLS,
    cost: int = CALL_MICRO_USD, daily: int = fixed.DAILY_SPEND, monthly: int = fixed.MONTHLY_SPEND, open_from: int = 21,
) -> DataFrame:
    """calls (ordinal, at, bucket, and by: whose budget it is) with reason: '' (it is made), 'calls', 'monthly' or 'daily'.

    A Korean day has total calls. General ones stop at general of all, until open_from o'clock; Go has the rest. So the first
    general calls of a day are made whatever they are, and of those after them the first total - general that may still be. What
    is made costs cost; it is held against the month first, then the day. Calls that aren't made use nothing up."""
    some = Window.unboundedPreceding
    day, month = Window.partitionBy(*by, "day_").orderBy("ordinal"), Window.partitionBy(*by, "month_").orderBy("ordinal")
    rows = calls.withColumns({"day_": korea_day(F.col("at")), "month_": korea_month(F.col("at")), "open_": (F.col("bucket") == "baduk") | (kst_hour(F.col("at")) >= open_from)})
    rows = rows.withColumn("place_", F.row_number().over(day))
    rows = rows.withColumn("late_", F.count_if(F.col("open_") & (F.col("place_") > general)).over(day.rowsBetween(some, 0)))
    rows = rows.withColumn("called_", (F.col("place_") <= general) | (F.col("open_") & (F.col("late_") <= total - general)))
    rows = rows.withColumn("paid_", F.col("called_") & (F.count_if("called_").over(day.rowsBetween(some, 0)) * cost <= daily))
    before = F.coalesce(F.count_if("paid_").over(month.rowsBetween(some, -1)), F.lit(0))
    reason = F.when(~F.col("called_"), "calls").when((before + 1) * cost > monthly, "monthly").when(~F.col("paid_"), "daily").otherwise("")
    return rows.withColumn("reason", reason).select(*calls.columns, "reason")


# --- one call a run -------------------------------------------------------------------------------------

#: Task: columns of its result after run.
TASKS = {"duplicates": [("id", T.LongType()), ("same_id", T.LongType())], "titles": [("id", T.LongType()), ("title", T.StringType())]}
NEEDED = {"run": T.StringType(), "kind": T.StringType(), "place": T.LongType(), "id": T.LongType(), "title": T.StringType()}


def _index(entry, name: str, among: list):
    """What an entry of an answer points at, or None."""
    i = entry.get(name) if isinstance(entry, dict) else None
    return among[i] if isinstance(i, int) and not isinstance(i, bool) and 0 <= i < len(among) else None


def checked(task: str, answer: str, new: list[tuple[int, str]], known: list[tuple[int, str]]) -> dict:
    """By id of a new title what a model's answer says of it, without what points nowhere or is empty; the last entry of an id counts."""
    out = {}
    for entry in json_array(answer) or []:
        if task == "duplicates":
            one, same = _index(entry, "new", new), _index(entry, "same", known)
            if one and same:
                out[one[0]] = same[0]
        else:
            one, title = _index(entry, "index", new), isinstance(entry, dict) and str(entry.get("title") or "").strip()[:TITLE]
            if one and title:
                out[one[0]] = title
    return out


class ModelCall:
    """Table function (rows, task, provider): rows (run, kind 'known' or 'new', place, id, title), one call a run. A provider is
    named as module:class; what it raises leaves its run without rows, as a run is better off without an answer than not at all."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, task: AnalyzeArgument, provider: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("rows must be a table")
        have = {f.name: f.dataType for f in rows.dataType.fields}
        if wrong := [f"{n} {t.simpleString()}" for n, t in NEEDED.items() if have.get(n) != t]:
            raise ValueError(f"rows need {', '.join(wrong)}")
        if task.value not in TASKS:
            raise ValueError(f"task must be one of {', '.join(TASKS)}")
        schema = T.StructType([T.StructField("run", T.StringType()), *[T.StructField(n, t) for n, t in TASKS[task.value]]])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("run")], orderBy=[OrderingColumn("kind"), OrderingColumn("place")])

    def __init__(self):
        self.run, self.task, self.provider = None, "", ""
        self.rows: dict[str, list[tuple[int, str]]] = {"new": [], "known": []}

    def eval(self, row, task, provider):
        self.run, self.task, self.provider = row["run"], task, provider
        if row["kind"] in self.rows:
            self.rows[row["kind"]].append((row["id"], row["title"]))

    def terminate(self):
        new, known = self.rows["new"], self.rows["known"][-KNOWN:]
        if not new or (self.task == "duplicates" and not known):
            return
        module, _, name = self.provider.partition(":")
        provider = getattr(import_module(module), name)()
        try:
            titles = [t for _, t in new]
            answer = provider.judge(titles, [t for _, t in known]) if self.task == "duplicates" else provider.retitle(titles)
        except Exception:
            return
        for i, found in checked(self.task, answer, new, known).items():
            yield self.run, i, found


def register(spark: SparkSession) -> None:
    spark.udtf.register("model_call", F.udtf(ModelCall))


def model_call(rows: DataFrame, task: str, provider: str = "newsloom.providers:Rules") -> DataFrame:
    """rows (run, kind, place, id, title): one call for each run. A run is what one call is meant to take: a batch of candidates
    (candidates.capped bounds it), and KNOWN titles."""
    spark = rows.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM model_call(TABLE({rows}), {task}, {provider})", rows=rows, task=task, provider=provider)


def duplicate_questions(candidates: DataFrame, stories: DataFrame, known: int = KNOWN) -> DataFrame:
    """Rows for model_call: candidates (run, day, id, title, at) that no free rule matched, and for each run and day the last known
    stories (day, id, title, at) that were told before it. A run's day is asked about on its own, as only stories of a candidate's
    own day count."""
    run = F.concat_ws("|", "run", "day")
    new = candidates.select(run.alias("run"), "day", "at", "id", "title")
    asked = new.groupBy("run", "day").agg(F.min("at").alias("at"))
    mixed = stories.select("day", "at", F.lit(None).cast("string").alias("run"), "id", "title").unionByName(asked.select("day", "at", "run", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("title")))
    order = Window.partitionBy("day").orderBy("at", F.col("run").isNull(), "id")
    counted = mixed.withColumn("n", F.count("id").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = counted.filter("id is not null").select("day", F.col("n").alias("place"), "id", "title")
    wanted = counted.filter("id is null and n > 0").select("run", "day", F.explode(F.sequence(F.greatest(F.col("n") - (known - 1), F.lit(1)), F.col("n"))).alias("place"))
    old = wanted.join(told, ["day", "place"]).select("run", F.lit("known").alias("kind"), F.col("place").cast("long"), "id", "title")
    place = F.row_number().over(Window.partitionBy("run").orderBy("at", "id")).cast("long")
    return old.unionByName(new.select("run", F.lit("new").alias("kind"), place.alias("place"), "id", "title"))
