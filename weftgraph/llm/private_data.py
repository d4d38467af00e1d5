"""Personal data by anchor expansion (operator 13)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from weftgraph.llm.common import bound_batches, table

#: The kinds of the base rules, then those that only anchors find, in the order of the outputs.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
#: Words that announce an account number.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn")
SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"[0-9][ ().0-9-]*")
_AUTHORITY = re.compile(r"[^\s/?#@\"<>]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
_CUED = re.compile(r"(?:[ \t]+(?:no|nr|number))?[ \t.:#=]{1,4}(?:([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})|([0-9](?:[ -]?[0-9]){5,16}))(?![A-Za-z0-9])")
_AUTOMATON = None


def _anchors():
    """The Aho-Corasick automaton of all anchors: at-signs, plus signs, digits, scheme marks and account cues."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for mark, kind in (("@", "@"), ("+", "+"), ("://", ":"), *((d, "0") for d in "0123456789")):
            made.add_word(mark, kind)
        for cue in CUES:
            for form in (cue, cue.title(), cue.upper()):
                made.add_word(form, cue)
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(x) * 2 - 9 * (x > "4") for x in even)) % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an IBAN fit."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(x, 36)) for x in turned)) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def private_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a text, by kind, then start.

    One pass of the automaton gives the anchors from left to right. At an anchor a parser reads as far as its
    kind's characters go, never over ground that the kind has used, so the time grows with the text's length:
    a match of a base rule holds exactly one at-sign or plus sign, or starts at the first digit of a run, so
    the spans are those that a leftmost search finds.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for end, kind in _anchors().iter(text):
        if kind == "0":
            if end >= done["ip"]:
                run = _DOTTED.match(text, end)
                done["ip"] = run.end()
                parts, at = run.group().split("."), end
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    stop = at + sum(map(len, four)) + 3
                    if all(map(_byte, four)):
                        found["ip"].append((at, stop))
                    at = stop + 1
            if end >= done["card"]:
                run = _CARD.match(text, end)
                done["card"] = run.end()
                if run.end() - end >= 13:
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((end, run.end()))
        elif kind == "@":
            start = end
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (domain := _DOMAIN.match(text, end + 1)):
                found["email"].append((start, domain.end()))
                done["email"] = domain.end()
        elif kind == "+":
            if run := _DIALLED.match(text, end + 1):
                number = run.group().rstrip(" ().-")
                if len(number) > 2 and 9 <= sum(x.isdigit() for x in number) <= 15:
                    found["phone"].append((end, end + 1 + len(number)))
        elif kind == ":":
            start = end - 2
            while start > done["url"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < end - 2 and text[start].isalpha() and (rest := _AUTHORITY.match(text, end + 1)):
                found["url"].append((start, rest.end()))
            done["url"] = end + 1
        elif end >= done["account"]:
            start = end + 1 - len(kind)
            if not (start and text[start - 1].isalnum()) and (rest := _CUED.match(text, end + 1)):
                number = 1 if rest[1] else 2
                if rest[2] or iban(rest[1].replace(" ", "")):
                    found["account"].append(rest.span(number))
                done["account"] = rest.end()
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def private_data(docs: DataFrame, *, text: str = "text", into: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Add to every row the spans of personal data in its whole text: (kind, start, end), code points, end exclusive.

    Kinds are email, ip, card and phone by fixed rules, and what only anchors find: url, an address with a user's name before its
    host, and account, a number behind an account cue, an IBAN only with fitting check digits. Spans of different
    kinds may overlap, those of one kind don't. A null or empty text has none. Rows stay as they are, repeated ones too, in any order and with any other
    columns, of which `keep` names those to return (all); one that is called `into` is replaced. No row is shuffled, and a row is judged by itself.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*(c for c in docs.columns if c != into and (keep is None or c in keep)), F.col(text).alias("__text"))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in private_spans(body or "")] for body in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.list_(kind))], [*batch.schema.names[:-1], into])

    return kept.mapInArrow(search, StructType(kept.schema.fields[:-1]).add(into, SPANS))


def redacted(found: DataFrame, *, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace the text of private_data()'s rows by one in which every span, or stretch of overlapping spans, is its kind in brackets.

    An overlap is named after the span that starts first, the longest of those; a null text stays null.
    """
    bound_batches(found.sparkSession)

    def mask(body: str | None, listed: list[dict]) -> str | None:
        if not body or not listed:
            return body
        out, at, ordered = [], 0, sorted((x["start"], -x["end"], x["kind"]) for x in listed)
        for start, stop, name in ordered:
            if start >= at:
                out += [body[at:start], f"[{name}]"]
            at = max(at, -stop)
        return "".join([*out, body[at:]])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [mask(*x) for x in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, text, pa.array(new, batch.schema.field(i).type))

    return found.mapInArrow(replace, found.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
