"""License scan by ordered signature rules.

A text is read as its words (letters and digits, A-Z lower-cased) joined by single spaces. A few stems decide whether
it is scanned at all, a keyword whether a rule's expression is tried. Rules have a priority; a detection within the
words of a stronger or earlier one is suppressed, so that "apache license version 2 0" is not reported as "apache
license" too. The four base phrases are counted apart and always keep their labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfunnel.llm.toxicity import tokens
from wayfunnel.llm._text import lean

#: Phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, keyword that a text must hold, and the name as an expression over words.
NAMES = [
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e(?: version)? (?:v )?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e(?: version)? (?:v )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e(?: version)? (?:v ?)?2(?: 0)?"),
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-0-clause", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|freebsd|two clause|2 clause) bsd|bsd 2 clause)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:(?:modified|new|revised|three clause|3 clause) bsd|bsd 3 clause)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:(?:original|four clause|4 clause) bsd|bsd 4 clause)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"(?:png reference library|libpng) licen[cs]e"),
    ("boost-1.0", "boost", r"boost software licen[cs]e(?: version 1 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?"),
    ("beerware", "beer", r"beer ?ware licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("json", "json", r"json licen[cs]e"),
    ("python-2.0", "python", r"python(?: software foundation)? licen[cs]e(?: version)?(?: 2(?: 0)?)?"),
    ("php-3.0", "php", r"php licen[cs]e version 3 0"),
    ("php-3.01", "php", r"php licen[cs]e version 3 01"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: version)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? 2(?: 0)?"),
    ("ofl-1.1", "font", r"sil open font licen[cs]e(?: version)?(?: 1 1)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: version)?(?: 1 0)?"),
    ("qpl-1.0", "public", r"q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[cs]e"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[cs]e(?: version)?(?: v?1 0)?"),
    ("pddl-1.0", "domain", r"public domain dedication and licen[cs]e"),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[cs]e"),
    ("cc0-1.0", "cc0", r"(?:creative commons zero|cc0)(?: v?1 0)?(?: universal)?"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: version)?(?: 1 0)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: version)?(?: 2 0)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: version)?(?: 1 1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: version)?(?: 2 0)?"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: version)?(?: 1)?"),
    ("proprietary", "rights", r"all rights reserved"),
    ("public-domain", "domain", r"(?:in|to|into) the public domain"),
]

#: Families whose versions differ in their number alone: label, keyword, name, versions.
FAMILIES = [
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ("1.0", "2.0")),
    ("eupl", "european", r"european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", ("1.0", "1.1")),
    ("afl", "academic", r"academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open", r"open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0")),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?", ("1.0", "1.1", "2.0", "2.1")),
    ("lppl", "latex", r"latex project public licen[cs]e", ("1.0", "1.1", "1.2", "1.3")),
    ("zpl", "zope", r"zope public licen[cs]e", ("1.1", "2.0", "2.1")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", ("1.1", "1.2", "1.3")),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e", ("1.0", "2.0", "3.0")),
    ("lgpl", "lesser", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2.0", "2.1", "3.0")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("1.0", "3.0")),
]

#: How a name is introduced, and the priority; a bare name is the weakest.
CONTEXTS = [
    ("identifier", 4, r"spdx licen[cs]e identifier (?:is )?"),
    ("grant", 3, r"(?:is |are )?(?:licen[cs]ed|released|distributed|published|available|provided|made available) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"),
    ("terms", 3, r"(?:under|subject to|according to|in accordance with) the terms (?:and conditions )?of (?:the )?"),
    ("name", 2, r""),
]
WEAK = {"proprietary", "public-domain"}
CONFIDENCE = {4: 0.99, 3: 0.95, 2: 0.8, 1: 0.4}
STEMS = (b" licen", b" spdx ", b" cc ", b" cc0 ", b" unlicense", b" wtfpl", b" creative commons ", b" all rights reserved ", b" public domain ",
         b" clause bsd ", b" bsd ")


class Rule(NamedTuple):
    label: str
    keyword: bytes
    priority: int
    expression: re.Pattern


class Found(NamedTuple):
    """A detection over the words ``start`` to ``stop``."""

    start: int
    stop: int
    label: str
    priority: int


def _signatures() -> Iterator[tuple[str, str, str]]:
    yield from NAMES
    for label, keyword, name, versions in FAMILIES:
        for version in versions:
            major, minor = version.split(".")
            number = rf"(?: version| v)?(?: v?{major} {minor}| v?{major}(?! [0-9]))" if minor == "0" else rf"(?: version| v)? v?{major} {minor}"
            yield f"{label}-{version}", keyword, name + number
            if label.endswith("gpl"):
                yield f"{label}-{version}-or-later", keyword, name + number + r" or (?:\(?at your option\)? )?(?:any )?later(?: version)?"
        yield label, keyword, name
    for parts in ("", "nc", "nd", "sa", "nc nd", "nc sa"):
        spelt = {"nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
        short = " ".join(["cc by", *parts.split()])
        long = " ".join(["creative commons attribution", *(spelt[p] for p in parts.split())])
        label = short.replace(" ", "-")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            yield f"{label}-{version}", "cc", rf"{short} {number}"
            yield f"{label}-{version}", "creative", rf"{long} {number}"
        yield label, "cc", short
        yield label, "creative", rf"{long}(?: international)?(?: public)?(?: licen[cs]e)?"


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules, strongest first; every name in every context."""
    out = []
    for label, keyword, name in _signatures():
        for _, priority, context in CONTEXTS:
            if label in WEAK and context:
                continue
            out.append(Rule(label, b" " + keyword.encode(), 1 if label in WEAK else priority, re.compile(f" {context}{name}(?= )".encode())))
    return sorted(out, key=lambda r: -r.priority)


def detections(words: list[bytes]) -> list[Found]:
    """Detections that no stronger, longer or earlier one contains, in the order of the text."""
    text = b" %b " % b" ".join(words)
    if not any(stem in text for stem in STEMS):
        return []
    found, present = set(), {}
    for rule in rules():
        if rule.keyword not in present:
            present[rule.keyword] = rule.keyword in text
        if present[rule.keyword]:
            for m in rule.expression.finditer(text):
                start = text.count(b" ", 0, m.start())
                found.add(Found(start, start + m[0].count(b" "), rule.label, rule.priority))
    kept: list[Found] = []
    for x in sorted(found, key=lambda x: (-x.priority, x.start - x.stop, x.start, x.label)):
        if not any(k.start <= x.start and x.stop <= k.stop for k in kept):
            kept.append(x)
    return sorted(kept)


_BASE = [(f" {phrase} ".encode(), label) for phrase, label in BASE.items()]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """First word and label of every place of a base phrase."""
    text = b" %b " % b" ".join(words)
    out = []
    for phrase, label in _BASE:
        at = text.find(phrase)
        while at >= 0:
            out.append((text.count(b" ", 0, at), label))
            at = text.find(phrase, at + 1)
    return sorted(out)


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", spans: bool = True) -> DataFrame:
    """Scan every whole text for licenses.

    Returns for each input row the id, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and
    ``last_word`` (their first and last start; null without one), ``base_labels`` and ``labels`` (distinct, sorted,
    comma-joined; empty without one), ``score`` (confidence of the strongest detection, 0 without one) and, where asked
    for, ``spans`` (start, stop, label, priority). Null and empty texts have no words; repeated rows are scanned each;
    other columns are not read. A map without a shuffle.
    """
    fields = [T.StructField(id_column, docs.schema[id_column].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")] + [T.StructField("score", T.DoubleType())]
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("priority", pa.int32())])
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("label", T.StringType()),
            T.StructField("priority", T.IntegerType())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = tokens(text.as_py())
                base, found = base_places(words), detections(words)
                labels = {label for _, label in base}
                score = max([CONFIDENCE[x.priority] for x in found] + [CONFIDENCE[2]] * bool(base), default=0.0)
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
                             ",".join(sorted(labels | {x.label for x in found})), score, [x._asdict() for x in found]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds[:len(fields) - 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.name for f in fields])

    return docs.select(id_column, text_column).mapInArrow(lean(run), T.StructType(fields))
