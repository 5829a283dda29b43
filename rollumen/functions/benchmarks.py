"""Raw benchmark tables as records of one form: images (paths), query, response, and what else a benchmark has.

Each function takes a raw table (columns as the benchmark publishes them) and gives one record a row; nothing is downloaded. Images stay in the
table as bytes, in the column `image_bytes`, with the path that a record names; a row that has to have an image and has none is an error when it is
read. Null texts count as empty; surrounding white space goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollumen.functions.text import strip
from rollumen.sources.readers import SPLITS

# What benchmarks append to their questions, and their files.
OPTION_SUFFIX = "\nAnswer with the option's letter from the given choices directly."
WORD_SUFFIX = "\nAnswer the question using a single word or phrase."
CHOICES = " Select from the following choices.\n"
LISTED = {
    "en": (
        " The choices are listed below:\n",
        "\nSelect the best answer to the above multiple-choice question based on the image. Respond with only the letter (A, B, C, D, or E) of the correct option.\nThe best answer is: ",
    ),
    "cn": (" 选项如下所示:\n", "\n根据图像选择上述多项选择题的最佳答案。只需回答正确选项的字母（A, B, C, D 或 E）。\n最佳答案为： "),
}
FILES = {
    "zoombench": "zoombench.json", "vstar": "vstar.json", "hrbench-4k": "hr_bench_4k.json", "hrbench-8k": "hr_bench_8k.json", "mme-realworld": "MME_RealWorld.json",
    "mme-realworld-cn": "MME_RealWorld_CN.json", "mmstar": "mmstar.json", "pope": "POPE.json", "pope_adv": "POPE_adv.json", "pope_pop": "POPE_pop.json",
    "pope_random": "POPE_random.json", "cv-bench": "cv_bench.json", "mmvp": "mmvp.json",
}


def file_of(benchmark: str) -> str:
    if benchmark not in FILES:
        raise ValueError(f"no benchmark {benchmark}; there are {', '.join(sorted(FILES))}")
    return FILES[benchmark]


def _text(c: Column | str) -> Column:
    return strip(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def _or(c: str, other: str) -> Column:
    """A text, or `other` where it is null or empty."""
    return F.when(F.length(c) > 0, F.col(c)).otherwise(F.lit(other))


def _needed(image: Column, key: Column) -> Column:
    return F.when(image.isNull(), F.raise_error(F.concat(F.lit("no image for "), key.cast("string"))).cast("binary")).otherwise(image)


def _path(folder: str, name: Column) -> Column:
    return F.array(F.concat(F.lit(folder + "/"), name, F.lit(".jpg")))


def _number(c: Column, width: int) -> Column:
    return F.format_string(f"%0{width}d", c.cast("long"))


def _asked(question: Column, suffix: str) -> Column:
    """With what the benchmark asks for, unless the question ends so."""
    return F.when(F.endswith(question, F.lit(suffix.strip())), question).otherwise(F.concat(question, F.lit(suffix)))


def _record(images: Column, data: Column, query: Column, response: Column, **more: Column) -> list[Column]:
    return [images.alias("images"), data.alias("image_bytes"), query.alias("query"), response.alias("response"), *[v.alias(k) for k, v in more.items()]]


def zoombench(raw: DataFrame, folder: str = "ZoomBench_images", crops: str = "ZoomBench_crop_images") -> DataFrame:
    """id, query, response, image and crop_image (struct<bytes>); a row without an id is named by `row`, its number."""
    key = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.col("row").cast("string"))
    crop = F.when(F.col("crop_image.bytes").isNotNull(), _path(crops, key)).otherwise(F.array().cast("array<string>"))
    return raw.select(*_record(_path(folder, key), _needed(F.col("image.bytes"), key), _text("query"), _text("response"), crop_images=crop, crop_bytes=F.col("crop_image.bytes")))


def vstar(raw: DataFrame, folder: str = "VStar_images") -> DataFrame:
    """image (struct<bytes>), text, label, question_id, category; a row without a question_id is named by `row`."""
    key = F.when(_text("question_id") == "", F.col("row").cast("string")).otherwise(F.col("question_id").cast("string"))
    query = _asked(_text("text"), OPTION_SUFFIX)
    return raw.select(*_record(_path(folder, key), _needed(F.col("image.bytes"), key), query, F.upper(_text("label")), question_id=key, category=_or("category", "unknown")))


def hrbench(raw: DataFrame, folder: str = "HRBench_images") -> DataFrame:
    """index, question, answer, A to D, category, image (base64); empty options are left out."""
    lines = F.filter(F.array(*[F.when(_text(x) != "", F.concat(F.lit(f"({x}) "), _text(x))) for x in "ABCD"]), lambda x: x.isNotNull())
    query = F.when(F.size(lines) > 0, F.concat(_text("question"), F.lit(CHOICES), F.array_join(lines, "\n"))).otherwise(_text("question"))
    key = F.col("index").cast("long")
    return raw.select(*_record(_path(folder, _number(key, 5)), F.unbase64(F.coalesce("image", F.lit(""))), query, _text("answer"), index=key, question_id=key, category=_text("category")))


def mme_realworld(raw: DataFrame, language: str = "en", folder: str = "MME_RealWorld_Full_images") -> DataFrame:
    """bytes (base64), index, question, `multi-choice options` (array), answer."""
    before, after = LISTED[language]
    lines = F.filter(F.transform(F.coalesce("multi-choice options", F.array().cast("array<string>")), lambda x: _text(x)), lambda x: x != "")
    query = F.when(F.size(lines) > 0, F.concat(_text("question"), F.lit(before), F.array_join(lines, "\n"), F.lit(after))).otherwise(_text("question"))
    key = F.coalesce(F.col("index").cast("long"), F.lit(0))
    return raw.select(*_record(_path(folder, _number(key, 6)), F.unbase64(F.coalesce("bytes", F.lit(""))), query, _text("answer"), index=key, question_id=key))


def mmstar(raw: DataFrame, folder: str = "MMStar_images") -> DataFrame:
    """index, question, answer, category, l2_category, image (binary)."""
    key = F.coalesce(F.col("index").cast("long"), F.lit(0))
    more = {"category": _or("category", "unknown"), "l2_category": _or("l2_category", "unknown")}
    return raw.select(*_record(_path(folder, _number(key, 5)), _needed(F.col("image"), key), _text("question"), F.upper(_text("answer")), index=key, question_id=key, **more))


def pope(raw: DataFrame, split: str = "test", folder: str = "POPE_images") -> DataFrame:
    """id, question_id, question, answer, category, image_source, image (binary) and `row`, its number, which stands in for ids."""
    number = F.col("row").cast("string")
    named = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), number)
    category, source = _or("category", split), F.when(F.length("image_source") > 0, F.col("image_source")).otherwise(named("id"))
    path = _path(folder, F.concat_ws("_", category, _number(F.col("row"), 5), source))
    query = _asked(_text("question"), WORD_SUFFIX)
    return raw.select(*_record(path, F.col("image"), query, F.lower(_text("answer")), index=F.col("row").cast("long"), id=named("id"), question_id=named("question_id"), category=category, image_source=source))


def cv_bench(raw: DataFrame, dimension: str = "2D", folder: str = "CVBench_images") -> DataFrame:
    """idx, type, task, image (struct<bytes>), prompt, answer, source."""
    key = F.coalesce(F.col("idx").cast("long"), F.lit(0))
    more = {"type": _or("type", dimension), "task": _or("task", ""), "source": _or("source", "")}
    return raw.select(*_record(_path(folder, _number(key, 5)), _needed(F.col("image.bytes"), key), _text("prompt"), _text("answer"), index=key, question_id=key, **more))


def mmvp(raw: DataFrame, folder: str = "MMVP Images", images: DataFrame | None = None) -> DataFrame:
    """Index, Question, Options, `Correct Answer` (text of a CSV file). images (path): a record whose image isn't among them is an error."""
    key = F.col("Index").cast("long")
    out = raw.select(*_record(_path(folder, key.cast("string")), F.lit(None).cast("binary"), F.concat(_text("Question"), F.lit(" "), _text("Options")), _text("Correct Answer"), index=key, question_id=key))
    if images is None:
        return out
    there = images.select(F.col("path").alias("_there")).distinct()
    missing = F.raise_error(F.concat(F.lit("no image at "), F.col("images")[0])).cast("array<string>")
    return out.join(there, F.col("images")[0] == F.col("_there"), "left").withColumn("images", F.when(F.col("_there").isNull(), missing).otherwise(F.col("images"))).drop("_there")


def records(raw: DataFrame, benchmark: str) -> DataFrame:
    """A benchmark's records, by its name."""
    file_of(benchmark)
    if benchmark in SPLITS:
        return pope(raw, SPLITS[benchmark])
    of = {"zoombench": zoombench, "vstar": vstar, "hrbench-4k": hrbench, "hrbench-8k": hrbench, "mmstar": mmstar, "cv-bench": cv_bench, "mmvp": mmvp, "mme-realworld": mme_realworld}
    return of[benchmark](raw) if benchmark in of else mme_realworld(raw, "cn")
