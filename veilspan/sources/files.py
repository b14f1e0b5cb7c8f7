"""Documents, subject lists, gold files and audit logs as tables; sinks for masked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "type string, session_id string, step string, layer string, timestamp double, entity_count bigint, validation_result string, flags array<string>, latency_ms double, pii_scan_result string, retry_count bigint, error_type string, rollback_occurred boolean"


def decode(content: Column) -> Column:
    """UTF-8, else TIS-620, else CP874; null where none fits. Valid UTF-8 does not go to Python."""
    @F.pandas_udf("string")
    def run(column):
        def one(b):
            for name in ("utf-8", "tis-620", "cp874"):
                try:
                    return bytes(b).decode(name)
                except UnicodeDecodeError:
                    pass
            return None

        return column.map(one, na_action="ignore")

    text = F.call_function("try_validate_utf8", content.cast("string"))
    return F.when(text.isNotNull(), text).otherwise(run(F.when(text.isNull(), content)))


def documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, source_type, text, error) of .txt and .pdf files; other files are skipped(). PDFs carry no text here."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{txt,pdf}").load(path)
    pdf = F.lower("path").endswith(".pdf")
    text = F.when(~pdf, decode(F.col("content")))
    error = F.when(pdf, F.lit("no PDF reader")).when(text.isNull(), F.lit("unknown encoding"))
    return raw.dropDuplicates(["path"]).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.when(pdf, "pdf_text").otherwise("text").alias("source_type"), text.alias("text"), error.alias("error"))


def skipped(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Names of files that documents() passes over."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    return raw.where(~F.lower("path").rlike(r"\.(txt|pdf)$")).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def subject_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, slice string, layer string, annotated string").json(path)


def audit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Audit rows; lines that are no JSON, or have no type, are left out."""
    lines = spark.read.text(path).where(F.get_json_object("value", "$.type").isNotNull())
    return lines.select(F.from_json("value", AUDIT).alias("r")).select("r.*")


def audit_page(rows: DataFrame, offset: int = 0, limit: int = 100, order: str = "timestamp") -> DataFrame:
    """One page, newest first, with the total of all rows on each."""
    page = rows.orderBy(F.desc(order), *[c for c in rows.columns if c != order and rows.schema[c].dataType.typeName() != "array"]).offset(max(0, offset)).limit(min(max(1, limit), 1000))
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def synthetic(spark: SparkSession, n: int, templates: list[tuple[str, str]], seed: int = 42) -> DataFrame:
    """n texts from (slice, template) pairs; {digits} becomes ten digits of a hash of (seed, id)."""
    k = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(templates))).cast("int")
    digits = F.lpad(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(10**10)).cast("string"), 10, "0")
    pick = lambda j: F.element_at(F.array(*[F.lit(t[j]) for t in templates]), k + 1)
    return spark.range(n).select(F.col("id").alias("doc_id"), pick(0).alias("slice"), F.replace(pick(1), F.lit("{digits}"), digits).alias("text"))


#: (text before, type, text after) of documents with one value; hard ones have it glued to Thai text, or in international form.
CORE = (("เลขบัตรประชาชน ", "THAI_ID", " ครับ"), ("อีเมล ", "EMAIL", " ค่ะ"), ("โทร ", "PHONE", " นะคะ"), ("ติดต่อเบอร์ ", "PHONE", ""))
HARD = (("เลขบัตรประชาชน", "THAI_ID", "ครับ"), ("อีเมล", "EMAIL", "ค่ะ"), ("โทร ", "PHONE66", ""))


def synthetic_gold(spark: SparkSession, size: int, seed: int = 42) -> DataFrame:
    """(doc_id, slice, text, spans) of size documents with one value each: the first fifth (three at least) are hard_case, the others
    core. Values come from hashes of (seed, id), so a retried task writes the same."""
    hard = F.col("id") < max(3, size // 5)
    choose = lambda pool, j: F.element_at(F.array(*[F.lit(x[j]) for x in pool]), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(pool))).cast("int") + 1)
    part = lambda j: F.when(hard, choose(HARD, j)).otherwise(choose(CORE, j))
    number = F.lpad(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(10**11)).cast("string"), 11, "0")
    body = F.concat(F.lit("1"), number)
    total = sum((F.substring(body, i, 1).cast("int") * (14 - i) for i in range(1, 13)), F.lit(0))
    citizen = F.concat(body, ((F.lit(11) - total % 11) % 10).cast("string"))
    kind = part(1)
    value = F.when(kind == "THAI_ID", citizen).when(kind == "EMAIL", F.concat(F.lit("user"), number, F.lit("@example.co.th"))).when(kind == "PHONE66", F.concat(F.lit("+668"), F.substring(number, 1, 8))).otherwise(F.concat(F.lit("08"), F.substring(number, 1, 8)))
    s = F.length(part(0))
    span = F.struct(s.alias("s"), (s + F.length(value)).alias("e"), F.regexp_replace(kind, "66", "").alias("data_type"))
    return spark.range(size).select(F.col("id").alias("doc_id"), F.when(hard, "hard_case").otherwise("core").alias("slice"), F.concat(part(0), value, part(2)).alias("text"), F.array(span).alias("spans"))


def newest(files: DataFrame, most: int = 50) -> DataFrame:
    """Of (path, modificationTime) the newest files."""
    return files.orderBy(F.desc("modificationTime"), "path").limit(most)


def audit_files(spark: SparkSession, folder: str, most_files: int = 50, most_rows: int = 5_000) -> DataFrame:
    """Audit rows of a folder's newest files, newest rows first."""
    names = [r.path for r in newest(spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(folder).select("path", "modificationTime"), most_files).collect()]  # so many at most
    rows = audit(spark, names) if names else spark.createDataFrame([], AUDIT)
    return rows.orderBy(F.desc("timestamp")).limit(most_rows)


def export(df: DataFrame, path: str, fmt: str = "json", halted: bool = False, overwrite: bool = False) -> None:
    """Writes in one of a few formats, unless validation halted the text; refuses to overwrite unless told to."""
    if halted:
        raise ValueError("validation halted this text")
    if fmt not in ("json", "parquet", "text"):
        raise ValueError(f"unknown format {fmt}")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    getattr(writer, fmt)(path)


def write_text(docs: DataFrame, path: str, text_column: str = "text", overwrite: bool = False) -> None:
    """One text for each row; refuses to overwrite unless told to."""
    docs.select(F.col(text_column).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n\x1e\n").text(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
