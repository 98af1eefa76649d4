"""From files or texts to records: chunks, calls, merge, second passes, validation, provenance and cost in one plan.

A run is lazy up to the calls. Their results are written to the shared checkpoint folder, so no action
repeats a paid call, and a lost executor costs the unfinished ones only; all that follows is relational.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.paths import long_form, successful_leaves, unquoted, value_at
from fieldspark.functions.tokens import BUDGET, count_tokens, estimate
from fieldspark.operators import completeness, merge, provenance, usage, voting
from fieldspark.operators.batches import slices
from fieldspark.operators.dedup import dedup_items, key_fields, normal_key
from fieldspark.operators.distribute import semantic
from fieldspark.operators.mapper import ERROR, describe
from fieldspark.plans import prompts
from fieldspark.plans import schema as S
from fieldspark.plans.config import Config
from fieldspark.plans.extractors import Extractor, RuleExtractor, ask
from fieldspark.plans.validate import compiled, empty_required, pruned
from fieldspark.session import shared_folder

_ERROR = pa.struct([("type", pa.string()), ("message", pa.string()), ("traceback", pa.string()), ("item", pa.string())])
#: The documents' key inside a run; no name of the caller's can clash with those used here.
_ID = "_id"
#: Top fields from which on a schema is asked for in groups: always, or in documents of more than so many characters.
_WIDE, _WIDE_IF_LONG, _LONG = 30, 21, 50_000
_SUMS = ("requests", "tool_calls", "input_tokens", "output_tokens")
_CALL = "data string, requests long, tool_calls long, input_tokens long, output_tokens long, attempts int, rounds int, warnings array<string>, error " + ERROR


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def call(df: DataFrame, keys: list[str], extractor: Extractor, schema: S.Schema, prompt: str = "", text: str = "text", prompt_column: str | None = None, paths_column: str | None = None, config: Config | None = None) -> DataFrame:
    """keys, data (JSON text), usage, attempts, rounds, warnings and error of one call for each row.

    Calls of a task run at most ``max_concurrency`` at once. A failed call is a row with an error. With
    ``paths_column``, a row is asked only for the fields at its paths.
    """
    config = config or Config()
    wanted = F.col(paths_column) if paths_column else F.lit(None).cast("array<string>")
    plain = df.select(*keys, F.col(text).cast("string").alias("_text"), (F.col(prompt_column) if prompt_column else F.lit(prompt)).alias("_prompt"), wanted.alias("_paths"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[: len(keys)])

    parts: dict[tuple | None, tuple[S.Schema, Callable]] = {}

    def part(paths: list[str] | None) -> tuple[S.Schema, Callable]:
        """What is asked for at these paths, and its check; both are made once in a task."""
        if (key := None if paths is None else tuple(paths)) not in parts:
            wanted = schema if paths is None else S.focused(schema, paths)
            parts[key] = wanted, compiled(wanted)
        return parts[key]

    def one(text: str, request: str, paths: list[str] | None) -> tuple:
        try:
            wanted, check = part(paths)
            a = ask(extractor, text or "", wanted, request, config, check=check)
            return (json.dumps(a.data, ensure_ascii=False, default=str), *[a.usage.get(k, 0) for k in _SUMS], a.attempts, a.rounds, a.warnings, None)
        except Exception as e:
            if config.fail_fast:
                raise
            return (None, 0, 0, 0, 0, config.max_retries, 0, [], describe(e, (text or "")[:200]))

    kinds = (pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.list_(pa.string()), _ERROR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None if isinstance(extractor, RuleExtractor) else ThreadPoolExecutor(config.max_concurrency)
        for batch in slices(batches, len(keys)):
            rows = [*(pool.map if pool else map)(one, *(batch.column(len(keys) + k).to_pylist() for k in range(3)))]
            cols = [*zip(*rows)] or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(c, k) for c, k in zip(cols, kinds)]], [str(i) for i in range(len(keys) + len(kinds))])

    return plain.mapInArrow(run, f"{head}, {_CALL}")


def top_fields(df: DataFrame, keys: list[str], schema: S.Schema, data: str = "data") -> DataFrame:
    """(keys, ord, path, value) of the record's top fields."""
    return long_form(df, keys, data, [*schema.get("properties", {})])


def record(df: DataFrame, keys: list[str], key: str = "path", value: str = "value") -> DataFrame:
    """(keys, data): rows of fields as one JSON object each, keys in order of name."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.coalesce(F.col(value), F.lit("null")).alias("v"))))
    text = F.transform(pairs, lambda p: F.concat(F.to_json(F.array(p["k"])).substr(F.lit(2), F.length(F.to_json(F.array(p["k"]))) - 2), F.lit(":"), p["v"]))
    return df.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("data"))


@dataclass
class Result:
    """data: one row for each document (or item, for a root array); report: usage, cost and warnings by document; errors: failed calls; provenance: the source of each field, if wished."""

    data: DataFrame
    report: DataFrame
    errors: DataFrame
    provenance: DataFrame | None = None

    def renamed(self, doc: str) -> Result:
        """With the documents' key under its own name."""
        return Result(*[x if x is None else x.withColumnRenamed(_ID, doc) for x in (self.data, self.report, self.errors, self.provenance)])


class MultiPassError(Exception):
    """More passes of some documents failed than may: ``failed`` documents; ``result`` holds all that worked."""

    def __init__(self, result: Result, failed: int):
        super().__init__(f"too many passes failed in {failed} documents")
        self.result, self.failed = result, failed


@dataclass
class Engine:
    spark: SparkSession
    extractor: Extractor | None = None
    config: Config | None = None
    #: Tokens of a text column; None: a quarter of its characters.
    counter: Callable[[Column], Column] | None = None

    def __post_init__(self):
        self.extractor = self.extractor or RuleExtractor()
        self.config = self.config or Config()

    def chunks(self, docs: DataFrame, doc: str, schema: S.Schema, prompt: str = "", text: str = "text", least: int = 5000) -> DataFrame:
        """(doc, n_chunks, chunk_id, text, ...): documents beyond the token budget in about n chunks of whole sentences, the rest in one."""
        lit = lambda x: F.lit(len(x) // 4).cast("long")
        planned = estimate(docs.select(doc, F.col(text).alias("text")), count_tokens(F.col("text"), self.counter), lit(json.dumps(schema)), lit(prompt), F.lit(0).cast("long"), F.lit(self.config.model), S.is_array(schema), BUDGET)
        n = F.col("recommended_chunks") if self.config.chunking else F.lit(1).cast("long")
        return semantic(planned.select(doc, "text", n.alias("n_chunks")), [doc, "n_chunks"], "text", "n_chunks", least if self.config.chunking else 1 << 30)

    def _calls(self, chunks: DataFrame, keys: list[str], schema: S.Schema, prompt: str, **how: Any) -> DataFrame:
        # a shuffle's partitions are set by the volume of the data; small runs get enough of them to keep all workers busy
        n = max(self.config.max_workers, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        spread = chunks if isinstance(self.extractor, RuleExtractor) else chunks.repartition(n)
        return kept(call(spread, keys, self.extractor, schema, prompt, config=self.config, **how))

    def _placed(self, chunks: DataFrame, request: str, array: bool = False) -> DataFrame:
        """chunks with _ask: the request, with the place of the chunk where a document has several."""
        none = F.lit(None).cast("int")
        part = prompts.chunk_prompt(request, F.col("chunk_id"), F.col("n_chunks"), none, none, array)
        return chunks.withColumn("_ask", F.when(F.col("n_chunks") > 1, part).otherwise(F.lit(request)))

    def _report(self, calls: DataFrame, doc: str) -> DataFrame:
        """Usage, cost and what went wrong; one row for each document."""
        used = usage.usage_totals(calls, [doc]).withColumn("model", F.lit(self.config.model))
        said = calls.groupBy(doc).agg(F.count("*").alias("n_calls"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"))
        return usage.with_cost(used, usage.parse_prices(self.config.pricing)).join(said, doc)

    def extract(self, docs: DataFrame, schema: Any, prompt: str = "", doc: str = "doc_id", text: str = "text", examples: list | None = None, extra: bool = False, least: int = 5000) -> Result:
        """Records of all documents by the way that schema, size and settings ask for.

        A root array: items of all chunks, without repeats. Otherwise chunks are merged field by field;
        with ``adaptive`` a second pass asks for what is missing, and with ``multipass`` passes are put to the vote.
        A schema of 30 top fields is asked for group by group, one of 21 in documents of more than 50,000 characters.
        """
        inner = docs.select(F.col(doc).alias(_ID), F.col(text).alias("text"))
        asked = S.output_schema(schema, extra)
        fields = len(asked.get("properties", {}))
        if S.is_array(asked) or self.config.multipass or not self.config.field_chunking or fields < _WIDE_IF_LONG:
            try:
                return self._extract(inner, schema, prompt, examples, extra, least).renamed(doc)
            except MultiPassError as e:
                raise MultiPassError(e.result.renamed(doc), e.failed) from None
        request = prompts.full_prompt(prompt, examples)
        if fields >= _WIDE:
            return self._by_group(inner, asked, request, least).renamed(doc)
        long = F.coalesce(F.length("text") > _LONG, F.lit(False))
        few, many = self._extract(inner.where(~long), schema, prompt, examples, extra, least), self._by_group(inner.where(long), asked, request, least)
        both = [a.unionByName(b) for a, b in ((few.data, many.data), (few.report, many.report), (few.errors, many.errors))]
        return Result(*both, few.provenance).renamed(doc)

    def _extract(self, docs: DataFrame, schema: Any, prompt: str, examples: list | None, extra: bool, least: int) -> Result:
        doc, text = _ID, "text"
        asked = S.output_schema(schema, extra)
        request = prompts.full_prompt(prompt, examples)
        chunks = self.chunks(docs, doc, asked, request, text, least)
        if S.is_array(asked):
            return self._items(chunks, asked, request, doc)
        part = S.optional(asked)
        if self.config.multipass:
            return self._passes(chunks, asked, request, doc)
        calls = self._calls(self._placed(chunks, request), [doc, "chunk_id"], part, request, prompt_column="_ask")
        merged = self._merged(calls, asked, doc)
        found = self._records(merged, calls, doc)
        if self.config.adaptive:
            found, more = self._second(chunks, found, asked, request, doc)
            calls = calls.unionByName(more)
        data = self._checked(found, asked)
        traced = self._trace(merged, chunks, asked, doc) if self.config.provenance else None
        return Result(data, self._report(calls, doc), calls.where("error IS NOT NULL"), traced)

    def _merged(self, calls: DataFrame, schema: S.Schema, doc: str) -> DataFrame:
        fields = top_fields(calls.where("error IS NULL"), [doc, "chunk_id"], schema)
        return merge.merge_chunks(fields, [doc, "path"], "chunk_id")

    def _records(self, fields: DataFrame, calls: DataFrame, doc: str) -> DataFrame:
        """(doc, data): one record for each document that was asked about, empty if nothing was found."""
        return calls.select(doc).distinct().join(record(fields, [doc]), doc, "left").select(doc, F.coalesce("data", F.lit("{}")).alias("data"))

    def _checked(self, found: DataFrame, schema: S.Schema, data: str = "data") -> DataFrame:
        """found with faults: what the schema objects to in the merged record."""
        check = compiled(schema)

        @F.pandas_udf("array<string>")
        def faults(records: pd.Series) -> pd.Series:
            def one(text: str) -> list[str]:
                value = json.loads(text)
                return [f"{p}: required" for p in empty_required(value, schema)] or check(pruned(value, schema))

            return records.map(one)

        return found.withColumn("faults", faults(F.col(data)))

    def _items(self, chunks: DataFrame, schema: S.Schema, request: str, doc: str) -> Result:
        asked = S.completeness(schema) if self.config.completeness_retry else S.wrapped(schema)
        calls = self._calls(self._placed(chunks, request, True), [doc, "chunk_id"], S.optional(asked), request, prompt_column="_ask")
        if self.config.completeness_retry:
            parsed = F.try_parse_json("data")
            report = lambda k, t: F.try_variant_get(parsed, f"$.extraction_metadata.{k}", t)
            again = calls.where("error IS NULL").where(completeness.should_retry(report("extraction_complete", "boolean"), report("completeness_confidence", "double"), self.config.completeness_threshold))
            found = F.coalesce(F.json_array_length(F.get_json_object("data", "$.items")), F.lit(0))
            said = again.groupBy(doc).agg(F.min_by(report("reason", "string"), "chunk_id").alias("_reason"))
            had = calls.where("error IS NULL").select(doc, "chunk_id", found.alias("_found"))
            wanted = self._focus(chunks, had, request, doc).unionByName(again.select(doc, "chunk_id")).distinct().join(said, doc)
            wanted = wanted.join(had.groupBy(doc).agg(F.sum("_found").alias("_found")), doc).select(doc, "chunk_id", prompts.retry_prompt(F.col("_found"), F.col("_reason"), request).alias("_again"))
            second = self._calls(chunks.join(wanted, [doc, "chunk_id"]), [doc, "chunk_id"], S.optional(asked), request, prompt_column="_again")
            calls = calls.withColumn("_turn", F.lit(0)).unionByName(second.withColumn("_turn", F.lit(1)))
        else:
            calls = calls.withColumn("_turn", F.lit(0))
        items = F.from_json(F.get_json_object("data", "$.items"), "array<variant>")
        rows = calls.where("error IS NULL").select(doc, "chunk_id", "_turn", F.posexplode(items).alias("pos", "v"))
        fields = schema.get("items", {}).get("properties", {})
        at = lambda k: F.try_variant_get("v", f"$.{k}", "string")
        keys = [normal_key(at(k), at(k).isNotNull()) for k in key_fields(fields)]
        unique = dedup_items(rows, doc, ["chunk_id", "_turn", "pos"], keys)
        data = merge.merge_items(unique, doc, "chunk_id", "pos").select(doc, "item", "chunk_id", F.to_json("v").alias("data"))
        return Result(self._checked(data, schema.get("items", {})), self._report(calls.drop("_turn"), doc), calls.where("error IS NOT NULL"))

    def _focus(self, chunks: DataFrame, had: DataFrame, request: str, doc: str) -> DataFrame:
        """(doc, chunk_id): the chunks that hold the pages to read again.

        A chunk's pages are those whose marks stand in it; without any, chunks count as pages. had: (doc, chunk_id, _found).
        """
        marks, own = completeness.page_markers(F.col("text")), F.col("chunk_id") + 1
        places = chunks.select(doc, "chunk_id", F.coalesce(F.array_min(marks), own).alias("page_lo"), F.coalesce(F.array_max(marks), own).alias("page_hi"))
        rated = places.join(had, [doc, "chunk_id"], "left").withColumn("productive", F.col("_found") > 0)
        named = completeness.page_hints(F.lit(request))
        hints = places.select(doc).distinct().select(doc, F.array_min(named).alias("hint_lo"), F.array_max(named).alias("hint_hi")).where("hint_lo IS NOT NULL")
        focus = completeness.focus_range(rated, doc, hints).select(doc, F.col("page_lo").alias("_lo"), F.col("page_hi").alias("_hi"))
        return places.join(focus, doc).where((F.col("page_hi") >= F.col("_lo")) & (F.col("page_lo") <= F.col("_hi"))).select(doc, "chunk_id")

    def _second(self, chunks: DataFrame, found: DataFrame, schema: S.Schema, request: str, doc: str) -> tuple[DataFrame, DataFrame]:
        """A second pass for the documents, and only for the fields, that lack more than the threshold; it is told what is known."""
        size = S.complexity(schema)
        pages = chunks.groupBy(doc).agg(F.max("char_end").alias("_chars"))
        limit = F.lit(self.config.missing_threshold) if self.config.missing_threshold is not None else None
        leaves = [*S.leaves(schema)]
        lacking = found.join(pages, doc).withColumn("_v", F.parse_json("data"))
        if limit is None:
            limit = completeness.adaptive_threshold(F.lit(size["fields"]), F.lit(size["depth"]), F.lit(False), F.ceil(F.col("_chars") / 2500))
        gone = completeness.missing_fields(F.col("_v"), S.missable(schema), leaves, 0.0)
        lacking = lacking.withColumn("missing", gone).where(F.size("missing") / F.lit(max(1, len(leaves))) > limit).select(doc, "missing", successful_leaves(F.col("_v"), leaves).alias("_known"))
        again = chunks.join(lacking.withColumn("_again", prompts.focused_request(F.col("_known"), F.col("missing"), request)), doc)
        calls = self._calls(again, [doc, "chunk_id"], S.optional(schema), request, prompt_column="_again", paths_column="missing")
        second = record(self._merged(calls, schema, doc), [doc])
        wanted = lacking.select(doc, F.explode("missing").alias("path"))
        # only the wanted paths of the second pass take part
        more = long_form(second, [doc], "data", leaves).join(wanted, [doc, "path"], "left_semi")
        both = merge.merge_passes(long_form(found, [doc], "data", leaves), more, [doc, "path"], F.lit(True))
        both = both.where(F.col("value").isNotNull())
        return found.select(doc).join(rebuilt(both, doc, schema), doc, "left").select(doc, F.coalesce("data", F.lit("{}")).alias("data")), calls

    def _passes(self, chunks: DataFrame, schema: S.Schema, request: str, doc: str) -> Result:
        """Passes put to the vote. A pass of a document fails if one of its calls does, and then doesn't vote.

        Documents of which more passes fail than ``fail_threshold``, or all, have no record; with ``fail_fast`` they
        raise MultiPassError, which carries what worked.
        """
        passes = self.spark.range(1, self.config.passes + 1).withColumnRenamed("id", "pass")
        asked = self._placed(chunks, request).crossJoin(F.broadcast(passes))
        asked = asked.withColumn("_ask", F.concat(F.lit("Pass "), F.col("pass").cast("string"), F.lit(f" of {self.config.passes}.\n\n"), F.col("_ask")))
        careful = replace(self.config, fail_fast=False)
        every = kept(call(asked.repartition(max(self.config.max_workers, int(self.spark.conf.get("spark.sql.shuffle.partitions")))), [doc, "chunk_id", "pass"], self.extractor, S.optional(schema), request, prompt_column="_ask", config=careful))
        state = every.groupBy(doc, "pass").agg(F.bool_or(F.col("error").isNotNull()).alias("_failed"))
        most = self.config.passes - 1 if self.config.fail_threshold is None else min(self.config.fail_threshold, self.config.passes - 1)
        failures = kept(state.groupBy(doc).agg(F.count_if("_failed").alias("n_failed_passes")))
        good = state.where("NOT _failed").join(failures.where(F.col("n_failed_passes") <= most), doc).select(doc, "pass")
        calls = every.join(good, [doc, "pass"], "left_semi")
        fields = top_fields(calls, [doc, "chunk_id", "pass"], schema)
        by_pass = merge.merge_chunks(fields, [doc, "pass", "path"], "chunk_id")
        voted = voting.vote(by_pass, doc, self.config.strategy, "pass", "path")
        result = Result(self._checked(self._records(voted, calls, doc), schema), self._report(every, doc).join(failures, doc), every.where("error IS NOT NULL"))
        if self.config.fail_fast and (failed := failures.where(F.col("n_failed_passes") > most).count()):
            raise MultiPassError(result, failed)
        return result

    def extract_by_group(self, docs: DataFrame, schema: S.Schema, prompt: str = "", doc: str = "doc_id", text: str = "text") -> Result:
        """Group after group of the schema's fields, for schemas too wide for one call."""
        return self._by_group(docs.select(F.col(doc).alias(_ID), F.col(text).alias("text")), S.output_schema(schema), prompt).renamed(doc)

    def _by_group(self, docs: DataFrame, asked: S.Schema, prompt: str, least: int = 5000) -> Result:
        doc, chunks = _ID, self._placed(self.chunks(docs, _ID, asked, prompt, "text", least), prompt)
        parts = [self._calls(chunks, [doc, "chunk_id"], S.optional(g), prompt, prompt_column="_ask") for g in S.field_groups(asked).values()]
        fields = [self._merged(c, g, doc) for c, g in zip(parts, S.field_groups(asked).values())]
        rows, calls = fields[0], parts[0]
        for more, c in zip(fields[1:], parts[1:]):
            rows, calls = rows.unionByName(more), calls.unionByName(c)
        merged = merge.merge_groups(rows.withColumn("round", F.lit(1)), [doc, "path"], "round", "value", "path")
        return Result(self._checked(self._records(merged, calls, doc), asked), self._report(calls, doc), calls.where("error IS NOT NULL"))

    def batch(self, files: DataFrame, schema: Any, prompt: str = "", group: str = "group_id", order: str = "file_ord", path: str = "path", text: str = "text", **how: Any) -> Result:
        """One record for each group of files; group_key, the path of its first file, names it besides."""
        from fieldspark.functions.mime import mime_of, wrap_text

        body = wrap_text(F.col(path), F.lit(mime_of("txt")), F.coalesce(F.col(text), F.lit("")))
        rows = files.groupBy(group).agg(F.min_by(path, order).alias("group_key"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b")))).alias("_fs"))
        docs = rows.select(group, "group_key", F.array_join(F.transform("_fs", lambda x: x["b"]), "\n\n").alias("text"))
        out = self.extract(docs, schema, prompt, group, **how)
        return Result(out.data.join(docs.select(group, "group_key"), group), out.report, out.errors, out.provenance)

    def batch_improved(self, files: DataFrame, schema: Any, improver: Any, prompt: str = "", **how: Any) -> dict:
        """``batch`` with room for extra facts, and what ``improve`` makes of its results."""
        return self.improve(self.batch(files, schema, prompt, **(how | {"extra": True})), S.to_schema(schema), prompt, improver)

    def _trace(self, merged: DataFrame, chunks: DataFrame, schema: S.Schema, doc: str) -> DataFrame:
        """The source of every field, of nested ones by their dotted paths."""
        v, leaves = F.try_parse_json("value"), []
        for leaf in S.leaves(schema):
            top, _, rest = leaf.partition(".")
            leaves.append(F.when(F.col("path") == top, F.struct(F.lit(leaf).alias("field"), unquoted(value_at(v, rest) if rest else F.col("value")).alias("value"))))
        rows = merged.select(doc, "source_chunks", F.inline(F.filter(F.array(*leaves), lambda x: x.isNotNull()))).where("value IS NOT NULL")
        rows = rows.select(doc, "field", "value", F.element_at("source_chunks", 1).alias("chunk_id"), F.lit(None).cast("double").alias("confidence"))
        places = chunks.select(doc, "chunk_id", F.col("text").alias("content"), F.array(F.col("chunk_id") + 1).alias("page_range"), F.lit(None).cast("int").alias("page"), F.col(doc).cast("string").alias("source_file"))
        return provenance.track(rows, places, [doc, "chunk_id"])

    def improve(self, result: Result, schema: S.Schema, prompt: str, improver: Any, shown: int = 20) -> dict:
        """A better schema and request: improver gets one prompt with the extra keys' counts and some results (``shown`` at most)."""
        counts = {r["key"]: r["n"] for r in extra_keys(result.data).orderBy(F.desc("n"), "key").limit(100).collect()}
        some = [json.loads(r["data"]) for r in result.data.orderBy(result.data.columns[0]).select("data").limit(shown).collect()]
        better = improver(prompts.improvement_prompt(schema, prompt, some, counts))
        return {"results": result, "improved_schema": better.get("schema", schema), "improved_user_prompt": better.get("prompt", prompt)}


def rebuilt(rows: DataFrame, doc: str, schema: S.Schema) -> DataFrame:
    """(doc, data): rows (doc, path, value) of dotted paths as one JSON object each, keys in order of name; one aggregate, however deep the schema.

    Values are used once in the expression, so it grows with the leaves of the schema and not with its depth.
    """

    def node(part: S.Schema, prefix: str) -> Column:
        fields = []
        for name, f in sorted(part.get("properties", {}).items()):
            inner = isinstance(f, dict) and f.get("type") == "object" and bool(f.get("properties"))
            value = node(f, f"{prefix}{name}.") if inner else F.try_element_at("_values", F.lit(prefix + name))
            fields.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), value))  # null without a value
        return F.concat(F.lit("{"), F.nullif(F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("")), F.lit("}"))

    values = rows.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_values"))
    return values.select(doc, F.coalesce(node(schema, ""), F.lit("{}")).alias("data"))


def extra_keys(data: DataFrame, record_column: str = "data") -> DataFrame:
    """(key, n): how many records hold each key under ``extra``."""
    extra = F.from_json(F.get_json_object(record_column, "$.extra"), "map<string,string>")
    return data.select(F.explode(F.map_keys(extra)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
