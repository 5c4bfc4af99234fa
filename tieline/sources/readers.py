"""Readers of the corpus, sidecar and log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PEOPLE = (
    "name string, givenName string, familyName string, email string, alternateName string, additionalName string, "
    "affiliation struct<legalName: string>"
)
MESSAGE = (
    "_header boolean, scenario_name string, condition string, metadata map<string,string>, sender string, recipients array<string>, "
    "body string, turn_id int, timestamp string, in_reply_to int, transcript string"
)
VERDICT = (
    "scenario_name string, condition string, mean_score double, scores map<string, struct<score: double, justification: string>>, "
    "turn_flags array<map<string,string>>, overall_summary string"
)
TOOL_CALL = (
    "scenario_name string, condition string, agent string, turn_id int, tool string, args map<string,string>, result_summary string, "
    "result_chars int, latency_ms double, error string, timestamp string"
)
RUN = (
    "question_id string, category string, question string, tool_calls array<struct<name: string, args: map<string,string>, "
    "result_summary: string, latency_ms: double, error: string>>, n_tool_calls int, wall_time_ms double, final_body string, "
    "pass boolean, reason string, grading_kind string"
)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """People directory from a JSON array; missing keys become ""."""
    j = spark.read.schema(PEOPLE).json(path, multiLine=True)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return j.select(
        "name", text("givenName").alias("given_name"), text("familyName").alias("family_name"), text("email").alias("email"),
        text("alternateName").alias("folder_name"), text("additionalName").alias("additional_name"), text("affiliation.legalName").alias("organisation"),
    )


def read_mail(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw mail table; ``limit`` is for development only."""
    df = spark.read.parquet(path)
    return df.limit(limit) if limit else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_organisations(spark: SparkSession, path: str, top: int) -> DataFrame:
    """Nested organisation list, the ``top`` by mail volume."""
    one = "domain string, company_name string, category string, relationship_type string, total_emails bigint"
    j = spark.read.schema(f"organizations array<struct<{one.replace(' string', ': string').replace(' bigint', ': bigint')}>>").json(path, multiLine=True)
    return j.select(F.inline("organizations")).orderBy(F.desc_nulls_last("total_emails"), "domain").limit(top)


def read_log(spark: SparkSession, path: str, schema: str, key: list[str], sequence: str | None = None) -> DataFrame:
    """Append-only JSON lines: blank, broken and key-less lines are skipped, the last record per key wins.

    "Last" is the greatest (file time, file, position in file), or first the greatest ``sequence`` of the records, for logs
    that many tasks write: a partial ``max_by``, no ordering.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_path", F.monotonically_increasing_id().alias("_pos"))
    good = raw.where("trim(value) <> ''").withColumn("_r", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = good.where("_r._bad is null")
    for k in key:
        good = good.where(F.col(f"_r.{k}").isNotNull())
    order = F.struct(*([f"_r.{sequence}"] if sequence else []), "file_modification_time", "file_path", "_pos")
    last = good.groupBy(*[F.col(f"_r.{k}").alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by("_r", order).alias("_r"))
    return last.select("_r.*").drop("_bad")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Messages with the header fields of their own file, or of their own ``transcript`` where a file's lines name several."""
    rows = spark.read.schema(MESSAGE).json(path, mode="DROPMALFORMED").select("*", F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("transcript", F.coalesce("transcript", F.lit("")))
    head = rows.where("_header").select("file", "transcript", "scenario_name", "condition", "metadata")
    body = rows.where("_header is null and sender is not null").drop("_header", "scenario_name", "condition", "metadata")
    return body.join(head, ["file", "transcript"]).drop("transcript")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERDICT).json(path, multiLine=True)


def read_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOOL_CALL).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path).withColumnRenamed("pass", "passed")


def read_labelled_sentences(spark: SparkSession, corpus: str, annotation: str, tags: dict[str, str]) -> DataFrame:
    """(sentence_id, sentence_text, acts): sentences with the union of all annotators' mapped tags.

    ``tags`` maps source tag → act; other tags are dropped.
    """
    sent = "array<struct<_id: string, _VALUE: string>>"
    docs = (
        spark.read.format("xml").option("rowTag", "thread")
        .schema(f"listno string, DOC array<struct<Text: struct<Sent: {sent}>>>").load(corpus)
    )
    text = docs.select(F.trim("listno").alias("listno"), F.explode("DOC").alias("d")).select("listno", F.explode("d.Text.Sent").alias("s"))
    text = text.select(F.concat_ws("/", "listno", "s._id").alias("sentence_id"), F.trim(F.coalesce("s._VALUE", F.lit(""))).alias("sentence_text"))
    mark = "array<struct<_id: string, _VALUE: string>>"
    fields = ", ".join(f"{t}: {mark}" for t in tags)
    notes = (
        spark.read.format("xml").option("rowTag", "thread")
        .schema(f"listno string, annotation array<struct<labels: struct<{fields}>>>").load(annotation)
    )
    per = notes.select(F.trim("listno").alias("listno"), F.explode("annotation.labels").alias("l"))
    def tagged(tag: str, act: str):
        return F.transform(F.coalesce(F.col(f"l.{tag}"), F.array().cast(mark)), lambda x: F.struct(x["_id"].alias("id"), F.lit(act).alias("act")))

    pairs = F.flatten(F.array(*[tagged(t, a) for t, a in tags.items()]))
    acts = (
        per.select("listno", F.inline(pairs))
        .groupBy(F.concat_ws("/", "listno", "id").alias("sentence_id"))
        .agg(F.array_sort(F.collect_set("act")).alias("acts"))
    )
    return text.join(acts, "sentence_id", "left").withColumn("acts", F.coalesce("acts", F.array().cast("array<string>")))


def table_cells(html, row: str, cells: int):
    """Array of structs (c0, c1, …) for every match of a row pattern with ``cells`` groups."""
    parts = [F.regexp_extract_all(html, F.lit(row), F.lit(i + 1)) for i in range(cells)]
    return F.arrays_zip(*[p.alias(f"c{i}") for i, p in enumerate(parts)])


def newest(spark: SparkSession, final: str, checkpoint: str, read_final, read_checkpoint) -> DataFrame:
    """The final table, unless it is absent or older than the live checkpoint log."""
    def written(path: str):
        try:
            return spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).agg(F.max("modificationTime")).first()[0]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    done, live = written(final), written(checkpoint)
    return read_final(final) if done is not None and (live is None or done >= live) else read_checkpoint(checkpoint)
