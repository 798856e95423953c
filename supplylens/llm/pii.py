"""Personal data replaced by surrogates (operator 6).

Detected entities get replacements of their own kind: the same layout of
digits, letters and marks, a card number that passes its check digit only if the original does, a name of
the same gender and script.  The surrogate is drawn from a keyed digest of
the entity's normal form, so every mention of an entity in every document, in whatever layout,
gets the same one, and without the key nothing leads back.

Two entities must not share a surrogate, and none may be an entity that
occurs.  Draws are checked over the whole corpus in rounds of groupings of
distinct entities; the later of two equal draws draws again.  Only these few redrawn
entities are joined to the documents that mention them; all others are drawn again in
the task that replaces, so no text is shuffled while they are few.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from hashlib import sha256
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The setting that holds the key of the registered query; where it is unset the query takes a key that only suits tests.
KEY_SETTING = "spark.supplylens.pii.key"
TEST_KEY = "for tests only"
# Fixed lists: given names by (script, gender), and syllables that surnames are made of.
GIVEN = {
    ("latin", "f"): "Alice Anna Clara Elena Emma Julia Laura Maria Nina Olivia Sofia Sarah".split(),
    ("latin", "m"): "Adam Carlos David Felix James John Lucas Martin Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Иван Михаил Николай Павел Сергей".split(),
}
SYLLABLES = {"latin": "ba de fi go hu ka le mi no pu ra se ti vo wa za lin mor ten ver".split(),
             "cyrillic": "ба ве ги до жу ка ле ми но пу ра се ти фо ха ша лин мор тен вер".split()}
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Sra Señora Г-жа".split(), "m": "Mr Herr M Monsieur Sr Señor Г-н".split()}

_LETTER = r"[A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё]"
_CAPITAL = rf"[A-ZÀ-ÖØ-ÞА-ЯЁ]{_LETTER}+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ]{_LETTER}+)?"
_GIVEN_OF = {n: k for k, names in GIVEN.items() for n in names}
# (type, character without which it can't occur, pattern); the entity is the last group, or all
PATTERNS = (
    ("email", "@", re.compile(r"(?<=[A-Za-z0-9])@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("secret", "=:", re.compile(
        r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_.~-]{8,})")),
    ("secret", "0123456789", re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[a-f]*\d)[0-9a-f]{32,})(?![0-9A-Za-z])")),
    ("ip", "0123456789", re.compile(
        r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")),
    ("ip", ":", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![\w:])")),
    ("iban", "0123456789", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", "0123456789", re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{5}))(?!\d)")),
    ("ssn", "0123456789", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", "0123456789", re.compile(
        r"(?<![\d\w])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
        r"|\d{3}[ .-]\d{3}[ .-]\d{4}|(?<!\.)(?=(?:[ /-]?\d){8,12}(?![ /-]?\d))0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2})(?!\d|\.\d)")),
    ("person", "", re.compile(
        rf"(?<!\w)(?:(?P<title>{'|'.join(t for k in TITLES.values() for t in k)})\.? (?:(?P<a>{_CAPITAL}) )?(?P<b>{_CAPITAL})"
        rf"|(?P<given>{'|'.join(_GIVEN_OF)}) (?P<last>{_CAPITAL}))(?!\w)")),
)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RANK = {k: i for i, k in enumerate(dict.fromkeys(p[0] for p in PATTERNS))}


def _digest(key: str, kind: str, norm: str, attempt: int):
    """An endless row of numbers below 2**32, fixed by its arguments."""
    block = 0
    while True:
        d = hmac.new(key.encode(), f"{kind}\0{norm}\0{attempt}\0{block}".encode(), sha256).digest()
        yield from (int.from_bytes(d[i:i + 4], "big") for i in range(0, 32, 4))
        block += 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text; of overlapping ones the earliest, then the kind listed first."""
    hits = []
    for kind, need, pattern in PATTERNS:
        if need and not any(c in text for c in need):
            continue
        last_end = 0
        for m in pattern.finditer(text):
            a, b, norm = m.start(), m.end(), m[0]
            if kind == "secret" and m.lastindex:
                (a, b), norm = m.span(1), m[1]
            elif kind == "ip" and ":" in norm:
                try:
                    norm = IPv6Address(norm).exploded
                except ValueError:  # a time, a ratio, ...
                    continue
            elif kind == "email":  # what is before the @ is read backwards, each character once
                while a > last_end and text[a - 1] in _LOCAL:
                    a -= 1
                if a == m.start():
                    continue
                last_end, norm = b, text[a:b].lower()
            elif kind in ("card", "phone"):
                norm = "".join(c for c in norm if c.isdigit())
            elif kind == "iban":
                norm = norm.replace(" ", "")
            elif kind == "person":
                if m["title"]:
                    a = m.start("a") if m["a"] else m.start("b")
                    gender = "f" if m["title"] in TITLES["f"] else "m"
                    given, last = m["a"] or "", m["b"]
                else:
                    given, last = m["given"], m["last"]
                    gender = _GIVEN_OF[given][1]
                script = "cyrillic" if re.search("[А-Яа-яЁё]", last) else "latin"
                norm = f"{script}|{gender}|{given}|{last}"
            hits.append((a, _RANK[kind], b, kind, norm))
    out, end = [], 0
    for a, _, b, kind, norm in sorted(hits):
        if a >= end:
            out.append((a, b, kind, norm))
            end = b
    return out


def surrogate(key: str, kind: str, norm: str, attempt: int = 0) -> str:
    """The normal form of the replacement."""
    numbers = _digest(key, kind, norm, attempt)
    if kind == "person":
        script, gender, given, _ = norm.split("|")
        pool, parts = GIVEN[script, gender], SYLLABLES[script]
        first = pool[next(numbers) % len(pool)] if given else ""
        last = "".join(parts[next(numbers) % len(parts)] for _ in range(4 + attempt)).capitalize()
        return f"{script}|{gender}|{first}|{last}"
    if kind == "ip" and ":" in norm:  # 2001:db8::/32 is for documentation
        return ":".join(["2001", "0db8", *(f"{next(numbers) % 65536:04x}" for _ in range(6))])
    if kind == "ip":  # 240.0.0.0/4 is assigned to nobody
        return ".".join(str(x) for x in (240 + next(numbers) % 15, *(next(numbers) % 256 for _ in range(3))))
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        return f"{_like(local, numbers)}@{_like(domain.rpartition('.')[0], numbers)}.invalid"
    if kind == "iban":
        return norm[:2] + _like(norm[2:], numbers)
    if kind == "phone":
        return norm[:1] + _like(norm[1:], numbers)
    out = _like(norm, numbers)
    if kind == "card":  # the last digit decides the check
        want = luhn(norm)
        out = next(out[:-1] + d for d in "0123456789" if luhn(out[:-1] + d) == want)
    return out


def _like(text: str, numbers) -> str:
    """Digits for digits, letters for letters of the same case (hexadecimal ones if all are), marks as they are."""
    hexed = re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", text) is not None
    low = "abcdef" if hexed else "abcdefghijklmnopqrstuvwxyz"
    out = []
    for c in text:
        pool = "0123456789" if c.isdigit() else low if c.islower() else low.upper() if c.isupper() else ""
        out.append(pool[next(numbers) % len(pool)] if pool else c)
    return "".join(out)


def rendered(kind: str, mention: str, value: str) -> str:
    """The surrogate's normal form in the layout of one mention."""
    if kind == "person":
        _, _, first, last = value.split("|")
        return f"{first} {last}" if first else last
    if kind in ("card", "phone", "iban"):
        letters = iter(value)
        return "".join(next(letters) if c.isalnum() else c for c in mention)
    if kind == "email" and mention.isupper():
        return value.upper()
    return value


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {(i, kind, norm) for i, text in enumerate(batch.column(2).to_pylist()) if text
                for _, _, kind, norm in find(text)}
        rows = sorted(rows)
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.string())], ["k", "text_hash", "kind", "norm"])


def _drawn(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [surrogate(key, *row) for row in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.string())], ["kind", "norm", "attempt", "value"])

    return run


def redraws(spark: SparkSession, entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first draw is taken.

    Rounds until all values are distinct and no value is an entity: of equal
    values that with the lowest attempt, then norm, keeps it (one partial aggregate).
    """
    drawn = entities.select("kind", "norm", F.lit(0).alias("attempt"))
    while True:
        drawn = common.land(spark, drawn.mapInArrow(_drawn(key), "kind string, norm string, attempt int, value string"), "drawn")
        owner = drawn.groupBy("kind", "value").agg(F.min(F.struct("attempt", "norm")).alias("o"), F.count("*").alias("n"))
        taken = owner.where("n > 1").select(F.col("kind").alias("_k"), F.col("value").alias("_v"), F.col("o.norm").alias("_o"))
        real = entities.select(F.col("kind").alias("_rk"), F.col("norm").alias("_rv"))
        marked = (drawn.join(taken, (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("_v")), "left")
                  .join(real, (F.col("kind") == F.col("_rk")) & (F.col("value") == F.col("_rv")), "left")
                  .withColumn("again", F.coalesce(F.col("_o") != F.col("norm"), F.lit(False)) | F.col("_rv").isNotNull()))
        marked = common.land(spark, marked.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"),
                                                  "again"), "redrawn")
        if marked.where("again").isEmpty():
            return drawn.where("attempt > 0").select("kind", "norm", "attempt")
        drawn = marked.select("kind", "norm", "attempt")


def _replaced(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, again in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hits = find(text) if text else []
                attempts = {(r["kind"], r["norm"]): r["attempt"] for r in again or ()}
                parts, end = [], 0
                for a, b, kind, norm in hits:
                    value = surrogate(key, kind, norm, attempts.get((kind, norm), 0))
                    parts += [text[end:a], rendered(kind, text[a:b], value)]
                    end = b
                texts.append("".join([*parts, text[end:]]) if hits else text)
                counts.append(len(hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                             ["k", "text", "n_entities"])

    return run


def pseudonymize(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str) -> DataFrame:
    """``id_col``, text with every entity replaced, and n_entities, for each row of ``docs``.

    Null text stays null, a text without entities stays as it is, equal rows
    give equal rows, an empty table an empty one; extra columns are ignored.
    The key has no default, and an empty one is refused: whoever has it can test guesses.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).cast("string").alias("text"))
    spans = common.land(spark, rows.mapInArrow(_spans, "k long, text_hash long, kind string, norm string"), "spans")
    again = common.land(spark, redraws(spark, common.land(spark, spans.select("kind", "norm").distinct(), "entities"), key), "again")
    # per document that mentions a redrawn entity: those entities (as many as it holds)
    per = (spans.join(again, ["kind", "norm"]).groupBy(F.col("k").alias("_k"), F.col("text_hash").alias("_h"))
           .agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("again")))
    per = common.small_side(common.land(spark, per, "redrawn-in"), row_bytes=512)
    same = F.col("k").eqNullSafe(F.col("_k")) & (F.col("text_hash") == F.col("_h"))
    return (rows.join(per, same, "left").select("k", "text", "again")
            .mapInArrow(_replaced(key), "k long, text string, n_entities long").withColumnRenamed("k", id_col))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(spark, common.table(spark, sf_dir, "documents"), key=spark.conf.get(KEY_SETTING, TEST_KEY))
