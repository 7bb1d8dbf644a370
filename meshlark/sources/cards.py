"""Knowledge cards: Markdown files in chunks by heading, their fields, and checks of a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import card_field

MOST_CHARS = 1800
#: Characters of chunks that a task hands on at once, unless one file has more.
CHUNK_CHARS = 1 << 20
#: The field that names a card.
ID = "Rule-ID"
MODES, PHASES = ("all", "behavioral_lab", "cloud_native"), ("topology", "configuration")
CHUNKS = "source string, chunk int, heading string, text string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of all Markdown files under a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("source"), F.col("value").alias("content"))


def pieces(text: str, most: int = MOST_CHARS) -> list[str]:
    """A text in parts of at most ``most`` characters, cut at the last line end of the second half, else hard."""
    out, text = [], text.strip()
    while len(text) > most:
        at = text.rfind("\n", most // 2, most)
        at = at if at >= 0 else most
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [p for p in [*out, text] if p]


def chunks(files: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(source, content) -> CHUNKS: a chunk starts at each line that begins with #, longer ones are cut.

    Cutting is sequential within a heading's text, so it runs per file in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["source", "chunk", "heading", "text"])
        for batch in batches:
            rows, held = [], 0
            for source, content in zip(batch["source"], batch["content"], strict=True):
                source, content = source.as_py(), content.as_py()
                lines = (content or "").splitlines()
                starts = [0, *(i for i, x in enumerate(lines) if x.startswith("#") and i), len(lines)]
                n = 0
                for a, b in zip(starts, starts[1:], strict=False):
                    heading = lines[a].strip() if a < b and lines[a].startswith("#") else "root"
                    for part in pieces("\n".join(lines[a:b]), most):
                        rows.append((source, n, heading, part))
                        n += 1
                        held += len(part)
                if held > CHUNK_CHARS:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    return files.select("source", "content").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """Chunks that carry a rule: (rule_id, source, heading, text, mode, phase)."""
    text = F.col("text")
    rows = chunks.select(card_field(text, ID).alias("rule_id"), "source", "heading", "text", card_field(text, "Mode").alias("mode"), card_field(text, "Phase").alias("phase"))
    return rows.where("rule_id <> ''")


def record_problems(records: DataFrame, required: list[str]) -> DataFrame:
    """(rule_id, problem): empty fields, unknown modes or phases, repeated ids, required rules that are missing or of another phase."""
    empty = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"empty_{c}")) for c in ("source", "heading", "text", "mode", "phase")]
    rules = [*empty, F.when(~F.col("mode").isin(*MODES), F.lit("unknown_mode")), F.when(~F.col("phase").isin(*PHASES), F.lit("unknown_phase")), F.when(F.col("rule_id").isin(*required) & (F.col("phase") != "topology"), F.lit("required_rule_of_another_phase"))]
    own = records.select("rule_id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    twice = records.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rule_id", F.lit("duplicate_rule").alias("problem"))
    wanted = records.sparkSession.createDataFrame([(r,) for r in required] or [("",)], "rule_id string").where("rule_id <> ''")
    gone = wanted.join(records, "rule_id", "left_anti").select("rule_id", F.lit("missing_rule").alias("problem"))
    return own.unionByName(twice).unionByName(gone)


def lint(chunks: DataFrame, fields: list[str], heading: str, sources: DataFrame) -> DataFrame:
    """(rule_id, problem) for authored cards: exactly the given fields, a well-formed heading, known related rules and registered sources (source_id)."""
    names = F.expr(r"regexp_extract_all(text, '(?m)^([A-Z][A-Za-z -]+): .+$', 1)")
    cards = chunks.withColumn("rule_id", card_field(F.col("text"), ID)).where("rule_id <> ''").withColumn("names", names)
    want = F.array(*[F.lit(f) for f in fields])
    missing = cards.select("rule_id", F.explode(F.array_except(want, "names")).alias("f")).select("rule_id", F.concat(F.lit("missing_field "), "f").alias("problem"))
    extra = cards.select("rule_id", F.explode(F.array_except("names", want)).alias("f")).select("rule_id", F.concat(F.lit("unexpected_field "), "f").alias("problem"))
    again = cards.where(F.size(F.array_distinct("names")) < F.size("names")).select("rule_id", F.lit("repeated_field").alias("problem"))
    badly = cards.where(~F.col("heading").rlike(heading)).select("rule_id", F.lit("bad_heading").alias("problem"))
    listed = lambda name: F.filter(F.transform(F.split(card_field(F.col("text"), name), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "none"))
    related = cards.select("rule_id", F.explode(listed("Related")).alias("other")).join(cards.select(F.col("rule_id").alias("other")), "other", "left_anti").select("rule_id", F.concat(F.lit("unknown_related "), "other").alias("problem"))
    cited = cards.select("rule_id", F.explode(listed("Sources")).alias("source_id")).join(sources.select("source_id"), "source_id", "left_anti").select("rule_id", F.concat(F.lit("unknown_source "), "source_id").alias("problem"))
    out = missing
    for part in (extra, again, badly, related, cited):
        out = out.unionByName(part)
    return out


def manifest(files: DataFrame, records: DataFrame) -> DataFrame:
    """(source, sha256, rules): a fingerprint for each file and its rules."""
    rules = records.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rule_id", F.sha2("text", 256).alias("sha256")))).alias("rules"))
    return files.select("source", F.sha2("content", 256).alias("sha256")).join(rules, "source", "left")


def token_count(text: str) -> int:
    """A stand-in for a model's tokenizer: a token for every four bytes."""
    return -(-len(re.sub(r"\s+", " ", text).encode()) // 4)


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cases from JSON lines, or from a JSON list in one file."""
    reader = spark.read.schema(schema)
    return reader.json(path) if path.endswith(".jsonl") else reader.json(path, multiLine=True)


def fresh(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose fingerprint is not stored (source, sha256): what a cache has to build anew."""
    now = files.withColumn("sha256", F.sha2("content", 256))
    return now.join(stored.select("source", "sha256"), ["source", "sha256"], "left_anti")
