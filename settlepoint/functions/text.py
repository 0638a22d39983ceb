"""Text surface forms, similarities, identities and reply parsing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Function words left out of content tokens (fixed values).
STOP_WORDS = (
    "a an the this that these those of in on at to for from by with without and or "
    "but is are was were be been being it its as into than then so such not no "
    "all any each both here there which who whom whose what when where why how "
    "do does did done has have had having will would should could can may might"
).split()
#: Separator of the parts of an identity (fixed value).
UNIT_SEPARATOR = "␟"
_WORDS = "[a-z0-9]+"
_WORDS_OR_OPERATORS = r"[a-z0-9]+|<=|>=|==|!=|\+=|-=|\*=|/=|%=|<|>|\+|-|\*|/|%|="


def tokens(text: Column, keep_operators: bool = False) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS_OR_OPERATORS if keep_operators else _WORDS), F.lit(0))


def normalize(text: Column, keep_operators: bool = False) -> Column:
    return F.array_join(tokens(text, keep_operators), " ")


def content_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays, 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def lexical(a: Column, b: Column) -> Column:
    """Set similarity of two content-token arrays: what SQL expresses of text_similarity."""
    return F.greatest(jaccard(a, b), 0.85 * overlap(a, b))


def _ratio(a: list[str], b: list[str]) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def _series_ratio(split: bool, a: Column, b: Column) -> Column:
    """The UDF is made where it is used: making it needs a running session."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(x, y, strict=True)
        return pd.Series([None if i is None or j is None else _ratio(i.split(), j.split()) if split else _ratio(i, j) for i, j in pairs], dtype="float64")

    return ratio(a, b)


def word_ratio(a: Column, b: Column) -> Column:
    """Order-sensitive matching-block ratio of two normalised texts, word by word (argument order counts); null of null."""
    return _series_ratio(True, a, b)


def char_ratio(a: Column, b: Column) -> Column:
    return _series_ratio(False, a, b)


def text_similarity(a: Column, b: Column) -> Column:
    """max(jaccard, word ratio, 0.85 * overlap) of two texts."""
    x, y = content_tokens(a), content_tokens(b)
    return F.greatest(lexical(x, y), word_ratio(normalize(a), normalize(b)))


def symmetric_similarity(a: Column, b: Column) -> Column:
    """max(jaccard, word ratio): containment alone does not count."""
    return F.greatest(jaccard(content_tokens(a), content_tokens(b)), word_ratio(normalize(a), normalize(b)))


def fingerprint(text: Column, unit: Column, scope: Column | None = None, keep_operators: bool = False) -> Column:
    parts = [normalize(text, keep_operators), F.lower(F.trim(F.coalesce(unit, F.lit(""))))]
    body = F.concat_ws(UNIT_SEPARATOR, *parts)
    if scope is not None:
        s = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
        body = F.when(s == "", body).otherwise(F.concat_ws(UNIT_SEPARATOR, s, body))
    return F.substring(F.sha1(body), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(":"), F.greatest(a, b))


def row_id(*parts: Column) -> Column:
    return F.concat(F.lit("r"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10))


def location_text(unit: Column, start: Column, end: Column) -> Column:
    span = F.when(start.isNull(), F.lit("")).when(end.isNull() | (end == start), F.concat(F.lit(":"), start.cast("string")))
    span = span.otherwise(F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when(unit.isNull(), F.lit("")).otherwise(F.concat(unit, span))


def sheet_location_text(unit: Column, start: Column, end: Column) -> Column:
    """The form of labelling sheets: a span is written in full even where it ends at its start."""
    span = F.concat(F.lit(":"), start.cast("string"), F.coalesce(F.concat(F.lit("-"), end.cast("string")), F.lit("")))
    return F.concat(F.coalesce(unit, F.lit("")), F.coalesce(span, F.lit("")))


def prompt_location_text(unit: Column, start: Column, end: Column) -> Column:
    """The form of prompts: a finding without a place is unlocalized."""
    return F.when(unit.isNull() & start.isNull(), F.lit("unlocalized")).otherwise(location_text(unit, start, end))


def suggested_delay(retry_after: Column, body: Column) -> Column:
    """Seconds that a server asks to wait: a numeric Retry-After header, else retryDelay of a JSON body, else null."""
    header = F.trim(retry_after)
    asked = F.nullif(F.regexp_extract(body, r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"', 1), F.lit(""))
    return F.coalesce(F.when(header.rlike(r"^(\d+\.?\d*|\.\d+)$"), header.try_cast("double")), asked.try_cast("double"))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def parse_verdict(reply: Column) -> Column:
    """true (same), false (different) or null: the first line's verdict, else an unambiguous mention."""
    up = F.upper(F.trim(reply, F.lit(" \t\r\n")))
    first = F.regexp_replace(F.element_at(F.split(up, r"\R"), 1), "^[^A-Z]+", "")
    same, different = up.rlike(r"\bSAME\b"), up.rlike(r"\bDIFFERENT\b")
    return (
        F.when(first.startswith("SAME"), True)
        .when(first.startswith("DIFFERENT"), False)
        .when(same & ~different, True)
        .when(different & ~same, False)
    )


FINDING = "struct<id:string,claim:string,location:struct<unit:string,start:int,end:int>,severity:string,evidence:string>"
SEVERITIES = ("info", "minor", "major", "critical")
_RECORDS = "array<struct<claim:string,unit:string,start:string,end:string,severity:string,evidence:string>>"


def parse_findings(reply: Column, round_index: Column) -> Column:
    """Findings of an extractor's reply: fences stripped, else the outermost array; invalid JSON gives none.

    Records without a claim are dropped, ids keep the record's position in the reply.
    """
    body = F.trim(reply, F.lit(" \t\r\n"))
    fenced = F.trim(F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(" \t\r\n"))
    body = F.when(body.contains("```") & (fenced != ""), fenced).otherwise(body)
    body = F.when(body.startswith("["), body).otherwise(F.regexp_extract(body, r"(?s)(\[.*\])", 1))
    records = F.coalesce(F.from_json(body, _RECORDS, {"mode": "PERMISSIVE"}), F.array().cast(_RECORDS))
    clean = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))

    def finding(r: Column, i: Column) -> Column:
        severity = F.lower(F.trim(F.coalesce(r["severity"], F.lit("minor"))))
        unit = clean(r["unit"])
        place = F.struct(unit.alias("unit"), r["start"].try_cast("int").alias("start"), r["end"].try_cast("int").alias("end"))
        return F.struct(
            F.concat(F.lit("r"), round_index.cast("string"), F.lit("-f"), i.cast("string")).alias("id"),
            clean(r["claim"]).alias("claim"),
            F.when(unit.isNotNull(), place).alias("location"),
            F.when(severity.isin(*SEVERITIES), severity).otherwise("minor").alias("severity"),
            clean(r["evidence"]).alias("evidence"),
        )

    return F.filter(F.transform(records, finding), lambda f: f["claim"].isNotNull())


#: Patterns of section headers and of a retirement line (fixed formats).
RETIRE_HEADER = r"(?i)^[\s#>*-]*RETIRE\b.*$"
NEW_HEADER = r"(?i)^[\s#>*-]*NEW(?:\s+ISSUES)?\b.*$"
RETIRE_LINE = r"(?i)^[\s>*\-]*(?:item\s*)?#?(\d{1,3})\b\s*[:.)\-—]?\s*(.*)$"


def split_sections(text: Column) -> Column:
    """struct(retire, new) of a review; without any header everything is new.

    A fold over the lines carries the section that the last header opened.
    """
    lines = F.split(text, "\n", -1)
    init = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("retire"), F.array().cast("array<string>").alias("new"))

    def step(s: Column, line: Column) -> Column:
        retire, new = line.rlike(RETIRE_HEADER), line.rlike(NEW_HEADER)
        at = F.when(retire, "retire").when(new, "new").otherwise(s["at"])
        body = ~(retire | new)
        return F.struct(
            at.alias("at"),
            F.when(body & (s["at"] == "retire"), F.array_append(s["retire"], line)).otherwise(s["retire"]).alias("retire"),
            F.when(body & (s["at"] == "new"), F.array_append(s["new"], line)).otherwise(s["new"]).alias("new"),
        )

    folded = F.aggregate(lines, init, step)
    none = ~F.exists(lines, lambda x: x.rlike(RETIRE_HEADER) | x.rlike(NEW_HEADER))
    return F.when(none, F.struct(F.lit("").alias("retire"), text.alias("new"))).otherwise(
        F.struct(F.array_join(folded["retire"], "\n").alias("retire"), F.array_join(folded["new"], "\n").alias("new"))
    )


def parse_retirements(block: Column, size: Column, min_reason_words: int = 2) -> Column:
    """Sorted 0-based ledger positions that a block retires with enough words of grounds."""

    def item(line: Column) -> Column:
        n = F.regexp_extract(line, RETIRE_LINE, 1).try_cast("int")
        words = F.size(F.filter(F.split(F.regexp_extract(line, RETIRE_LINE, 2), r"\s+"), lambda w: w != ""))
        return F.when((n >= 1) & (n <= size) & (words >= min_reason_words), n - 1)

    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(block, r"\R"), item), lambda i: i.isNotNull())))


#: Model families by a pattern of the model id (fixed values).
FAMILIES = (("anthropic", "(?i)claude"), ("openai", r"(?i)^(gpt|o\d)"), ("deepseek", "(?i)deepseek"), ("google", "(?i)gemini|gemma"))
PROVIDERS = {"anthropic": "anthropic", "openai": "openai", "deepseek": "deepseek", "google": "google", "gemini": "google"}
JUDGE_PREFERENCE = ("deepseek", "anthropic", "openai")


def model_family(model: Column) -> Column:
    out = F.lit("unknown")
    for family, pattern in reversed(FAMILIES):
        out = F.when(model.rlike(pattern), family).otherwise(out)
    return out


def spec_family(spec: Column) -> Column:
    provider, model = F.lower(F.trim(F.substring_index(spec, ":", 1))), F.regexp_extract(spec, ":(.*)$", 1)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv]), provider)
    family = model_family(model)
    return F.when((model != "") & (family != "unknown"), family).otherwise(F.coalesce(known, F.lit("unknown")))


def rotated_judge(loop_model: Column, pool: tuple[str, ...] = JUDGE_PREFERENCE) -> Column:
    """The first family of the pool that is not the loop model's, null if there is none."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, pool)), lambda f: f != model_family(loop_model)), F.lit(1))


def parse_label(text: Column) -> Column:
    """true, false or null of a hand-written label."""
    t = F.lower(F.trim(text))
    yes, no = ("same", "s", "1", "yes", "y", "true"), ("different", "diff", "d", "0", "no", "n", "false")  # fixed values
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def numbered_listing(text: Column) -> Column:
    """Lines with a number of width 4 and a bar, as shown for review."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def new_file_diff(path: Column, text: Column) -> Column:
    """A unified diff that adds a whole file."""
    lines = F.split(text, "\n", -1)
    head = F.concat(F.lit("--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"))


def diff_postimage(text: Column) -> Column:
    """array<struct<no, line>>: new-file numbers and lines of a unified diff."""
    def step(s: Column, line: Column) -> Column:
        header = line.startswith("@@")
        start = F.regexp_extract(line, r"\+(\d+)", 1).try_cast("int")  # null without a number: no hunk is open
        kept = s["no"].isNotNull() & ~header & (line.startswith("+") | line.startswith(" "))
        row = F.struct(s["no"].alias("no"), F.substr(line, F.lit(2)).alias("line"))
        no = F.when(header, start).when(kept, s["no"] + 1).otherwise(s["no"])
        return F.struct(no.alias("no"), F.when(kept, F.array_append(s["out"], row)).otherwise(s["out"]).alias("out"))

    init = F.struct(F.lit(None).cast("int").alias("no"), F.array().cast("array<struct<no:int,line:string>>").alias("out"))
    lines = F.split(F.regexp_replace(text, r"\n$", ""), r"\R", -1)
    return F.aggregate(lines, init, step, lambda s: s["out"])


def diff_file_name(text: Column) -> Column:
    """The new file's name from the first line of a diff that has it, else file."""
    plus, git = r"^\+\+\+ b/(.+)", r"^diff --git a/\S+ b/(\S+)"
    named = F.transform(F.split(text, r"\R"), lambda x: F.trim(F.coalesce(F.nullif(F.regexp_extract(x, plus, 1), F.lit("")), F.regexp_extract(x, git, 1))))
    return F.coalesce(F.try_element_at(F.filter(named, lambda x: x != ""), F.lit(1)), F.lit("file"))


def review_view(kind: Column, text: Column) -> Column:
    """What a reviewer sees: of code the numbered new file of its diff under its name, else the text itself."""
    width = lambda n: F.greatest(F.lit(4), F.length(n.cast("string")))
    rows = F.transform(diff_postimage(text), lambda x: F.concat(F.lpad(x["no"].cast("string"), width(x["no"]), F.lit(" ")), F.lit(" | "), x["line"]))
    head = F.concat(F.lit("File under review: "), diff_file_name(text), F.lit("\n(line numbers are shown at the left; cite them in your findings)\n\n"))
    return F.when(kind == "code", F.concat(head, F.array_join(rows, "\n"))).otherwise(text)


def extraction_prompt(artifact: Column, review: Column) -> Column:
    """The request for findings of a review as a JSON array (fixed wording)."""
    parts = ("--- ARTIFACT ---\n", artifact, "\n--- END ARTIFACT ---\n\n--- REVIEW ---\n", review, "\n--- END REVIEW ---\n\nReturn the JSON array of findings.")
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])
