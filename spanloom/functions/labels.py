"""Kinds, themes and the prose that states what evidence there is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import is_test_path

# Display labels of kinds, reading themes in their order, descriptions of unavailable sources, and sentences of evidence.
LABELS = {
    "moved": "Moved · identical AST",
    "renamed": "Renamed · matching statements",
    "moved_renamed": "Moved + renamed",
    "moved_modified": "Moved + edited · candidate",
    "modified": "Edited · review behavior",
    "source_only": "Source-only edit",
    "added": "Added to file",
    "removed": "Removed from file",
    "observed_head": "Addition unresolved",
    "observed_base": "Removal unresolved",
    "wiring": "Import wiring",
    "text": "Text-only change",
    "test": "Test change",
}
THEMES = ("query construction", "result parsing", "label normalization", "record merging", "value conversion", "implementation", "orchestration", "wiring", "tests", "supporting")
UNAVAILABLE = {
    "not_supplied": "source was not supplied; file absence is not confirmed",
    "size_limit": "source is unavailable because it exceeds the file size limit",
    "binary_or_non_utf8": "source is unavailable because it is binary or is not UTF-8",
    "unsupported_object": "source is unavailable because it is not a supported regular file",
    "invalid_content_size": "source is unavailable because its declared size is invalid",
    "unsupported_encoding": "source is unavailable because its encoding is unsupported",
    "read_failed": "source could not be read; file absence is not confirmed",
}
PARTIAL = "Only part of the {0} file is supplied."
UNPARSED = "The {0} Python source could not be parsed."
TEXT_ONLY = "The {0} source is text-only; Python parsing is not available."
REMOVED_FROM = "Definition {0} was removed from the supplied file {1}. "
ADDED_TO = "Definition {0} was added to the supplied file {1}. "
ABSENT_HEAD = "The base file is fully supplied and parsed. The file is confirmed absent at the head revision."
ABSENT_BASE = "The file is confirmed absent at the base revision. The head file is fully supplied and parsed."
BOTH_PARSED = "Both file versions are fully supplied and parsed. No counterpart was matched."
ELSEWHERE = " This result does not establish whether the definition or its behavior exists elsewhere in the repository."
UNRESOLVED = "Definition {0} is present in the supplied {1} source for {2}. {3} from this file is unresolved: {4}."
BOTH_PATHS = " Base path: {0}. Head path: {1}."
INTENT = "Follow {0} in {1}."
INTENT_MOVE = "Follow the relocation of {0}, pairing the old and new definitions instead of reading deletion and addition separately."
INTENT_TESTS = "Read the assertions as executable design claims. Their presence is evidence of test intent, not a passing run."
INTENT_WIRING = "Trace how this module resolves its imports after the implementation changes."
QUESTION = "Are observable outputs, exceptions and calling conventions preserved or intentionally changed?"
QUESTION_SAME = "Do imported globals, relative imports, initialization order or serialization depend on the previous module location?"
QUESTION_RENAMED = "Are imports, reflective lookups, doctests and references to the old name updated?"
QUESTION_WIRING = "Are old import paths intentionally retired or still needed by callers outside these changed files?"
QUESTION_TESTS = "Do these assertions exercise the changed behavior, including negative and boundary cases?"
INVARIANT = "Check the expected inputs, outputs and failure cases against both revisions."
INVARIANT_SAME = "The compared ASTs are identical, including literals, signatures and decorators."
INVARIANT_RENAMED = "The rename match preserves internal identifiers and literals; declaration name and leading docstring are excluded only for this explicitly labeled match."
INVARIANT_WIRING = "Each imported symbol must resolve at the new module path in the deployed build."
INVARIANT_TESTS = "Assertions should express the intended contract, not merely repeat the implementation."
NO_BASE = "No base definition in this unit"
NO_HEAD = "No head definition in this unit"
TAKEAWAY = "You have inspected {0} change unit(s) concerning {1}{2}."
RELATED = " and related symbols"
PROVENANCE = "deterministic evidence template"
REMAINS = "A definition with the same name and type remains in the other file version, but the matcher did not form one pair."
NOT_RUN = "referenced, not run"
AMBIGUOUS = "Ambiguous static binding"


def fill(sentence: str, *values: Column) -> Column:
    """A fixed sentence with its numbered places filled."""
    parts = [F.lit(p) if i % 2 == 0 else values[int(p)].cast("string") for i, p in enumerate(re.split(r"\{(\d)\}", sentence)) if i % 2 or p]
    return F.concat(*parts)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of ``key`` in a small fixed table, or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def label(kind: Column) -> Column:
    return lookup(kind, LABELS)


def theme_rank(theme: Column) -> Column:
    """Place of a theme in reading order."""
    return F.coalesce(lookup(theme, {t: str(i) for i, t in enumerate(THEMES)}).cast("int"), F.lit(THEMES.index("implementation")))


def change_kind(before: Column, after: Column) -> Column:
    """Kind of a matched pair of symbol structs, from paths, names and fingerprints."""
    moved = before["path"] != after["path"]
    same = before["fingerprint"] == after["fingerprint"]
    alike = before["rename_fingerprint"] == after["rename_fingerprint"]
    renamed = before["name"] != after["name"]
    return (
        F.when(same & moved, "moved").when(same, "source_only")
        .when(alike & renamed & moved, "moved_renamed").when(alike & renamed, "renamed")
        .when(moved, "moved_modified").otherwise("modified")
    )


def theme(kind: Column, name: Column, path: Column, is_test: Column) -> Column:
    """Reading theme of a change; the first rule that fits decides."""
    low = F.lower(name)
    return (
        F.when(F.coalesce(is_test, F.lit(False)) | is_test_path(path), "tests")
        .when(kind == "wiring", "wiring")
        .when(kind == "text", "supporting")
        .when(low.rlike("^(convert_|format_|populate_)"), "value conversion")
        .when(low.contains("label"), "label normalization")
        .when(low.contains("query") | name.endswith("_GRAPH") | path.rlike(r"(queries|query)\.py$"), "query construction")
        .when(low.contains("merge"), "record merging")
        .when(low.contains("parse"), "result parsing")
        .when(name.rlike("^(get_|fetch_|retrieve_)"), "orchestration")
        .otherwise("implementation")
    )


def side_blockers(side: str, state: Column, coverage: Column, reason: Column, statuses: Column) -> Column:
    """Why a file side cannot show that a definition is absent, in fixed order; empty for a confirmed absence."""
    unavailable = F.concat(F.lit(f"The {side} "), lookup(reason, UNAVAILABLE), F.lit("."))
    supplied = F.filter(
        F.array(
            F.when(coverage != "full", F.lit(PARTIAL.format(side))),
            F.when(F.array_contains(statuses, "failed"), F.lit(UNPARSED.format(side))),
            F.when(F.array_contains(statuses, "text_only"), F.lit(TEXT_ONLY.format(side))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(state == "absent", F.array().cast("array<string>")).when(state == "unavailable", F.array(unavailable)).otherwise(supplied)
