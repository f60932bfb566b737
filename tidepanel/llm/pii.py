"""Personal data: fixed forms first, then identifiers found through the contexts in which the fixed forms occur.

Seeds are the matches of the fixed forms (e-mail, IP address, payment card, phone). Every seed, and every other token that
could be an identifier (it holds digits or an at sign), induces lexical patterns: the word before it, the two words
before it, the word after it, and the words on both sides. Spark scores the graph of patterns and instances in rounds: a
pattern is as reliable for a kind as the confidence of its distinct instances says, by the lower end of a confidence
interval; an instance whose form agrees with the kind is as sure as its best reliable pattern. Tokens in a reliable
pattern become spans of its kind; matches of the fixed forms always stay.

The text is read once per row; the graph holds contexts and offsets only.

Defined results: null and empty texts have no spans; repeated rows each get theirs; equal strings are one instance, so
copies do not make a pattern reliable; offsets count code points, ends are exclusive; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import in_chunks
from tidepanel.llm.common import free_name, read, with_text_result
from tidepanel.scale import freeze

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
RELIABLE = 0.8
Z = 1.64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)(?=\S*[0-9@])\S++")
_EDGE = ".,;:!?()[]{}<>\"'|*#%&$"
AROUND = 64  # first look around a mention for its neighbour words, in code points; widened until they are whole


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind, then by start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _agrees(value: str) -> list[int]:
    """Kinds whose form an unseeded token could have."""
    digits = sum(c in "0123456789" for c in value)
    letters = any(c.isalpha() for c in value)
    out = []
    if letters and "@" in value[1:]:
        out.append(0)
    if not letters and digits >= 4 and len(re.findall(r"[.:]", value)) >= 3:
        out.append(1)
    if not letters and 12 <= digits <= 19:
        out.append(2)
    if not letters and 7 <= digits <= 15:
        out.append(3)
    return out


def _words_before(text: str, start: int, n: int) -> list[str]:
    """The last ``n`` words before ``start``, whole however long they are."""
    width = AROUND
    while True:
        low = max(0, start - width)
        parts = text[low:start].split()
        if parts and low and not (text[low - 1].isspace() or text[low].isspace()):
            del parts[0]  # its beginning lies further back
        words = [w for w in (p.strip(_EDGE).lower() for p in parts) if w]
        if len(words) >= n or not low:
            return words[-n:]
        width *= 4


def _words_after(text: str, end: int, n: int) -> list[str]:
    width = AROUND
    while True:
        high = min(len(text), end + width)
        parts = text[end:high].split()
        if parts and high < len(text) and not (text[high].isspace() or text[high - 1].isspace()):
            del parts[-1]
        words = [w for w in (p.strip(_EDGE).lower() for p in parts) if w]
        if len(words) >= n or high == len(text):
            return words[:n]
        width *= 4


def _patterns(text: str, start: int, end: int) -> list[str]:
    before, after = _words_before(text, start, 2), _words_after(text, end, 1)
    out = []
    if before:
        out.append("b " + before[-1])
        if len(before) > 1:
            out.append("bb " + " ".join(before[-2:]))
    if after:
        out.append("a " + after[0])
    if before and after:
        out.append(f"ba {before[-1]} {after[0]}")
    return out


def read_text(text: str) -> tuple[list, list]:
    """(fixed spans, mentions); a mention is (kind or -1, start, end, value, kinds it agrees with, patterns)."""
    spans = base_spans(text)
    mentions = [(k, a, b, text[a:b].lower(), [k], _patterns(text, a, b)) for k, a, b in spans]
    if "@" in text or _DIGIT.search(text):
        taken = sorted((a, b) for _, a, b in spans)
        at, reach = 0, -1
        for m in _TOKEN.finditer(text):
            token = m[0]
            core = token.strip(_EDGE)
            if not core:
                continue
            start = m.start() + token.index(core)
            end = start + len(core)
            # spans that begin before the token's end; the furthest end among them decides
            while at < len(taken) and taken[at][0] < end:
                reach = max(reach, taken[at][1])
                at += 1
            if reach > start:
                continue
            kinds = _agrees(core)
            if sum(c in "0123456789@" for c in core) >= 4 or kinds:
                mentions.append((-1, start, end, core.lower(), kinds, _patterns(text, start, end)))
    return spans, mentions


def span_text(spans) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SCHEMA = (
    "base array<struct<k:int,a:int,b:int>>, "
    "mentions array<struct<k:int,a:int,b:int,v:string,agrees:array<int>,patterns:array<string>>>"
)


def _read_texts(texts: list) -> list[tuple]:
    out = []
    for run in in_chunks([t or "" for t in texts]):
        for t in run:
            spans, mentions = read_text(t)
            out.append(
                (
                    [{"k": k, "a": a, "b": b} for k, a, b in spans],
                    [
                        {"k": k, "a": a, "b": b, "v": v if len(v) <= 64 else hashlib.sha256(v.encode()).hexdigest(), "agrees": g, "patterns": p}
                        for k, a, b, v, g, p in mentions
                    ],
                )
            )
    return out


def _lower_end(good: Column, n: Column) -> Column:
    """Lower end of the score interval for a share of ``good`` in ``n``."""
    p = F.least(good / n, F.lit(1.0))
    spread = F.sqrt(p * (1 - p) / n + Z * Z / (4.0 * n * n))
    return (p + Z * Z / (2.0 * n) - Z * spread) / (1 + Z * Z / n)


def score_patterns(mentions: DataFrame, rounds: int = ROUNDS, reliable: float = RELIABLE) -> DataFrame:
    """(pattern, kind, trust) of reliable patterns, from mentions (k, v, agrees, patterns)."""
    known = mentions.filter("k >= 0").select("v", F.col("k").alias("kind")).distinct()
    known = known.withColumn("trust", F.lit(1.0))
    edges = mentions.select("v", F.explode("patterns").alias("pattern")).distinct()
    edges = freeze(edges, "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    open_ = mentions.filter("k < 0").select("v", F.explode("agrees").alias("kind")).distinct()
    open_ = freeze(open_.join(known.select("v").distinct(), "v", "left_anti"), "open")
    trust = known
    for turn in range(rounds):
        sums = edges.join(trust, "v").groupBy("pattern", "kind").agg(F.sum("trust").alias("good"))
        scored = sums.join(sizes, "pattern").withColumn("trust", _lower_end(F.col("good"), F.col("n")))
        found = freeze(scored.filter(F.col("trust") >= reliable).select("pattern", "kind", "trust"), "patterns")
        if turn + 1 < rounds:
            new = edges.join(open_, "v").join(found, ["pattern", "kind"])
            new = new.groupBy("v", "kind").agg(F.max("trust").alias("trust"))
            trust = known.unionByName(new)
    return found


def annotate(df: DataFrame, text_col: str = "text", name: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all) and ``name``: base and all spans as arrays of (k, a, b)."""
    held, row = free_name(df, "_read"), free_name(df, "_row")
    out = with_text_result(df, text_col, _read_texts, SCHEMA, held)
    kept = df.columns if keep is None else keep
    out = out.select(*[F.col(f"`{c}`") for c in kept], held, F.monotonically_increasing_id().alias(row))
    out = freeze(out, "texts")
    mentions = out.select(F.col(row).alias("r"), F.explode(f"{held}.mentions").alias("m")).select("r", "m.*")
    patterns = score_patterns(mentions)
    late = mentions.filter("k < 0").select("r", "a", "b", F.explode("agrees").alias("kind"), "patterns")
    late = late.withColumn("pattern", F.explode("patterns")).join(patterns, ["pattern", "kind"])
    best = F.row_number().over(Window.partitionBy("r", "a", "b").orderBy(F.col("trust").desc(), "kind"))
    late = late.groupBy("r", "a", "b", "kind").agg(F.max("trust").alias("trust")).withColumn("n", best).filter("n = 1")
    # bounded by the tokens of one text
    late = late.groupBy("r").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "a", "b")).alias("late"))
    late = late.withColumnRenamed("r", row)
    late_name = free_name(out, "late")
    out = out.join(late.withColumnRenamed("late", late_name), row, "left")
    base = F.col(f"{held}.base")
    extra = F.coalesce(F.col(late_name), F.array().cast("array<struct<k:int,a:int,b:int>>"))
    both = F.array_sort(F.concat(base, extra))
    return out.withColumn(name, F.struct(base.alias("base"), both.alias("spans"))).drop(held, row, late_name)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["a"].cast("string"), s["b"].cast("string")))
    )


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the fixed forms, and all spans, of every row."""
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = annotate(base, keep=["doc_id"])
    fixed = F.col("pii.base")

    def count(k: int) -> Column:
        return F.size(F.filter(fixed, lambda s: s["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    digest = F.sha2(_joined(fixed).cast("binary"), 256).alias("base_sha256")
    return out.select("doc_id", *counts, digest, _joined(F.col("pii.spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its kind in angle brackets; other columns as they are."""
    name = free_name(df, "_pii")
    out = annotate(df, text_col, name)
    kind = "array<struct<k:int,a:int,b:int>>"
    spans = F.coalesce(F.col(f"{name}.spans"), F.array().cast(kind))
    done = F.arrow_udf(_replaced(), "string")(F.col(f"`{text_col}`").cast("string"), spans)
    return out.withColumn(text_col, done).drop(name)


def _replaced():
    """Texts with their spans replaced: pieces between spans, joined once. A span inside an earlier one adds nothing."""
    import pyarrow as pa

    def over(texts, spans):
        out = []
        for text, found in zip(texts, spans):
            text = text.as_py()
            if text is not None and len(found):
                pieces, at = [], 0
                for a, b, k in sorted((s["a"], -s["b"], s["k"]) for s in found.as_py()):
                    if a >= at:
                        pieces += [text[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, -b)
                text = "".join([*pieces, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    over.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    return over


def find_documents(spark, sf: str) -> DataFrame:
    return find(read(spark, sf, "documents"))


def redact_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: spans are replaced in the texts, ``n_chars`` follows."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)
