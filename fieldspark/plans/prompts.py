"""What an extractor is told."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.paths import bound

SYSTEM = "Fill in the fields of the given schema from the documents. Use only what they say, copy values as written, and leave a field null if nothing is said about it."
IMPROVE = "Below are results of an extraction. Name fields that often turn up under extra and belong in the schema, and reword the request so that fields which stay empty are found."
SHOWN_FIELDS, SHOWN_CHARS = 15, 50


def examples_block(examples: list) -> str:
    """Examples, each a record or a pair of an excerpt (or None) and a record."""
    out = []
    for i, example in enumerate(examples, 1):
        excerpt, record = example if isinstance(example, tuple | list) else (None, example)
        out += [f"Example {i}", *([f"Excerpt: {excerpt}"] if excerpt else []), f"Record: {json.dumps(record, ensure_ascii=False)}"]
    return "\n".join(out)


def full_prompt(user: str | None = None, examples: list | None = None, system: str = SYSTEM) -> str:
    return "\n\n".join(x for x in (system, examples_block(examples) if examples else "", user or "") if x)


def improvement_prompt(schema: dict, user: str | None, results: list, extra_counts: dict[str, int]) -> str:
    parts = [IMPROVE, f"Schema: {json.dumps(schema)}", f"Request: {user or '(none)'}", f"Keys under extra and how often: {json.dumps(extra_counts)}", f"Results: {json.dumps(results, ensure_ascii=False, default=str)}"]
    return "\n\n".join(parts)


def chunk_prompt(user: str, chunk_id: Column, n_chunks: Column, page_lo: Column, page_hi: Column, array: bool) -> Column:
    """The request for one chunk, with its place in the document."""
    part = F.concat(F.lit("part "), (chunk_id + 1).cast("string"), F.lit(" of about "), n_chunks.cast("string"))
    where = F.when(page_lo.isNotNull(), F.concat(F.lit("pages "), page_lo.cast("string"), F.lit(" to "), page_hi.cast("string"))).otherwise(part)
    what = "List every item that it holds." if array else "Fill in what it holds and leave the rest null."
    return F.concat(F.lit("This is "), where, F.lit(f". {what}\n\n{user}"))


def retry_prompt(found: Column, reason: Column, user: str) -> Column:
    return F.concat(F.lit("An earlier attempt found "), found.cast("string"), F.lit(" items and may be incomplete ("), F.coalesce(reason, F.lit("no reason given")), F.lit(f"). Go through the pages again and list all.\n\n{user}"))


def _shown(value: Any) -> str:
    text = str(value)
    return text if len(text) <= SHOWN_CHARS else text[: SHOWN_CHARS - 3] + "..."


def focused_prompt(found: dict[str, Any], missing: list[str], user: str) -> str:
    """A second request: some of what is known, and what is missing by section."""
    sections: dict[str, list[str]] = {}
    for path in missing:
        sections.setdefault(path.split(".")[0], []).append(path)
    known = [f"- {k}: {_shown(v)}" for k, v in [*found.items()][:SHOWN_FIELDS]]
    gaps = [f"- {s}: {', '.join(sorted(ps))}" for s, ps in sorted(sections.items())]
    return "\n".join(["Known so far:", *known, "Still missing:", *gaps, "Give only the missing fields.", "", user])


def known_fields(found: Column) -> Column:
    """``focused_prompt``'s list of what is known, of an array of structs (path, value)."""
    cut = lambda v: F.when(F.length(v) <= SHOWN_CHARS, v).otherwise(F.concat(F.substring(v, 1, SHOWN_CHARS - 3), F.lit("...")))
    return F.array_join(F.transform(F.slice(found, 1, SHOWN_FIELDS), lambda x: F.concat(F.lit("- "), x["path"], F.lit(": "), cut(x["value"]))), "\n")


def focused_request(found: Column, missing: Column, user: str) -> Column:
    """``focused_prompt`` for each row, of its array of structs (path, value) and its missing paths."""
    known = bound(found, lambda f: F.when(F.size(f) > 0, known_fields(f)))
    return F.concat_ws("\n", F.lit("Known so far:"), known, F.lit("Still missing:"), missing_by_section(missing), F.lit("Give only the missing fields.\n\n" + user))


def missing_by_section(missing: Column) -> Column:
    """``focused_prompt``'s list of gaps as one string: section, then its paths in order, for each section in order."""

    def lines(gone: Column) -> Column:
        heads = F.array_sort(F.array_distinct(F.transform(gone, lambda p: F.split_part(p, F.lit("."), F.lit(1)))))
        return F.transform(heads, lambda h: F.concat(F.lit("- "), h, F.lit(": "), F.array_join(F.array_sort(F.filter(gone, lambda p: F.split_part(p, F.lit("."), F.lit(1)) == h)), ", ")))

    return F.array_join(bound(missing, lines), "\n")
