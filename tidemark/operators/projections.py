"""Projections between words, sentences, cues and files, and field-wise merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as K

from tidemark.functions import styles, timecode
from tidemark.functions import text as T

Names = list[str]


def typed_words(words: DataFrame, start: str, end: str) -> DataFrame:
    """Words with times in seconds; a time that cannot be read is 0."""
    seconds = lambda c: F.coalesce(timecode.vtt_seconds(F.col(c)), F.lit(0.0))
    return words.withColumn(start, seconds(start)).withColumn(end, seconds(end))


def sentence_blocks(sentences: DataFrame, by: Names, order: Names, text: str, start: str, end: str) -> DataFrame:
    """by, idx from 1, times (a line with commas before the milliseconds), origin of each sentence in order."""
    idx = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    times = timecode.srt_line(timecode.vtt_to_srt(F.col(start)), timecode.vtt_to_srt(F.col(end)))
    return sentences.select(*by, idx.alias("idx"), times.alias("times"), F.col(text).alias("origin"))


def dub_cues(plan: DataFrame, by: Names, order: Names, start: str, end: str, text: str) -> DataFrame:
    """Cues of a plan in order: idx from 1, its new times, the text cleaned for speech."""
    idx = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return plan.select(*by, idx.alias("idx"), F.col(start).alias("start"), F.col(end).alias("end"), T.clean_speech(F.col(text)).alias("text"))


def fixed_chunks(words: DataFrame, by: Names, order: Names, text: str, size: int) -> DataFrame:
    """by, chunk from 0, n, text of every run of `size` words."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    rows = words.withColumn("chunk", F.floor(place / size).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return rows.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p["__t"]), " ").alias("text"))


def speech_text(items: DataFrame, by: Names, order: Names, text: str) -> DataFrame:
    """by, text: what a chunk says, its items' words between single spaces, empty items left out."""
    said = F.array_join(T.fields(F.col(text)), " ")
    parts = F.array_sort(F.collect_list(F.struct(*order, said.alias("__t"))))
    kept = F.filter(F.transform(parts, lambda p: p["__t"]), lambda t: t != "")
    return items.groupBy(*by).agg(F.array_join(kept, " ").alias("text"))


def result_files(tasks: DataFrame, keys: Names, result: str, ui: str, origin: str, target: str) -> DataFrame:
    """keys, place, kind, name of the files that a task gives.

    The origin always, the target unless the result is origin-only, the bilingual file for target-on-top and
    target-on-bottom; names are in the language of the user interface, empty where that has none.
    """
    named = lambda en, zh: F.when(F.col(ui) == "en", en).when(F.col(ui) == "zh_cn", zh).otherwise("")
    of = lambda lang: named(F.concat(F.col(lang), F.lit(" Subtitle")), F.concat(F.col(lang), F.lit(" 单语字幕")))
    both = F.col(result).isin("target-on-top", "target-on-bottom")
    row = lambda place, kind, name: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), name.alias("name"))
    rows = F.array(row(1, "origin", of(origin)), F.when(both | (F.col(result) == "target-only"), row(2, "target", of(target))), F.when(both, row(3, "bilingual", named(F.lit("Bilingual Subtitle"), F.lit("双语字幕")))))
    return tasks.select(*keys, F.explode(F.array_compact(rows)).alias("__f")).select(*keys, "__f.*")


def first_rows(rows: DataFrame, by: Names, order: Names, most: int) -> DataFrame:
    """The first rows of each medium."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def merged(base: Column, override: Column, kind: K.StructType) -> Column:
    """A struct with each field of `override` that is set, the base's elsewhere; nested structs field by field.

    A string is set if it is not empty, anything else if it is not null.
    """
    out = []
    for field in kind:
        a, b = base.getField(field.name), override.getField(field.name)
        if isinstance(field.dataType, K.StructType):
            value = merged(a, b, field.dataType)
        else:
            value = F.coalesce(F.nullif(b, F.lit("")) if isinstance(field.dataType, K.StringType) else b, a)
        out.append(value.alias(field.name))
    return F.struct(*out)


def _given(value: Column, kind: str) -> Column:
    return F.nullif(value, F.lit("")) if kind == "string" else value


def resolved_styles(rows: DataFrame, keys: Names, shared: str, own: str) -> DataFrame:
    """keys, source, fault, styles: the defaults, below the set of the shared file, below that of the row's own file.

    Files come as JSON texts; a null shared file, or a null or blank own one, sets nothing. Where a file is at fault there are no
    styles, but its source (shared before own) and the path that styles.set_fault gives. A field is checked by itself,
    so that what good files give together is good.
    """
    given = rows.select(*keys, F.col(shared).alias("__a"), F.when(T.trim(F.col(own)) != "", F.col(own)).alias("__b"))
    fault = lambda c: F.when(F.col(c).isNotNull(), styles.set_fault(F.col(c)))
    found = given.select("*", fault("__a").alias("__fa"), fault("__b").alias("__fb"), styles.style_set(F.col("__a")).alias("__sa"), styles.style_set(F.col("__b")).alias("__sb"))
    # field by field from the files' own columns: a struct laid on a struct would repeat the lower one in each field
    files = [F.col("__sb"), F.col("__sa")]
    role = lambda screen, role: F.struct(*(F.coalesce(*(_given(f[screen][role][name], kind) for f in files), styles.default_value(screen, role, name)).alias(name) for name, kind in styles.KINDS.items())).alias(role)
    # a version of 0 counts as none
    version = F.coalesce(*(F.nullif(f["version"], F.lit(0)) for f in files), F.lit(1))
    laid = F.struct(version.alias("version"), *(F.struct(*(role(screen, r) for r in styles.ROLES)).alias(screen) for screen in styles.SCREENS))
    source = F.when(F.col("__fa").isNotNull(), "shared").when(F.col("__fb").isNotNull(), "own")
    fault = F.coalesce("__fa", "__fb")
    return found.select(*keys, source.alias("source"), fault.alias("fault"), F.when(fault.isNull(), laid).alias("styles"))


# What is said of tasks that are not known or have failed, and the status of the latter.
UNKNOWN_TASK, FAILED_TASK, FAILED = "任务不存在", "任务失败，原因：", 3


def task_states(wanted: DataFrame, tasks: DataFrame, fields: Names) -> DataFrame:
    """For each wanted task_id, error and the task's fields: these are null where the task is unknown or has failed.

    tasks(task_id, status, fail_reason, ...) has one row for each task.
    """
    known = tasks.select("task_id", F.lit(True).alias("__known"), F.col("status").alias("__status"), F.col("fail_reason").alias("__reason"), *fields)
    failed = F.col("__status") == FAILED
    error = F.when(F.col("__known").isNull(), UNKNOWN_TASK).when(failed, F.concat(F.lit(FAILED_TASK), F.coalesce("__reason", F.lit(""))))
    rows = wanted.join(known, "task_id", "left").withColumn("error", error)
    return rows.select(*wanted.columns, "error", *(F.when(F.col("error").isNull(), F.col(f)).alias(f) for f in fields))


MANIFEST = "struct<provider: map<string, string>, stages: map<string, struct<ok: boolean, error: string>>>"


def manifests(files: DataFrame) -> DataFrame:
    """Columns and provider, stages of manifest files; missing maps are empty, unknown keys are ignored."""
    j = F.from_json("value", MANIFEST)
    empty = lambda name, kind: F.coalesce(j[name], F.from_json(F.lit("{}"), kind)).alias(name)
    return files.select("*", empty("provider", "map<string, string>"), empty("stages", "map<string, struct<ok: boolean, error: string>>"))
