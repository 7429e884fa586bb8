"""Secret scan: three fixed kinds, and strings that stay new to a primed compressor.

Beside ``assign``, ``access`` and ``hex``, a run of key-like signs that starts at most ``REACH`` characters after a
sensitive word is a candidate, whatever its length and signs; dots inside join the parts of a token.  Its novelty is
what it adds, in bytes, to a zstandard frame primed with a dictionary of common identifiers and the text around it, divided
by what a random string of its alphabet holds.  The frame begins with ordinary prose, code, names and numbers, which
settles what a letter or digit costs, so short strings are measured too: words, identifiers, slugs and paths
cost less than their alphabet holds, random keys more.  Separators are taken for blanks, and strings without small letters
for small ones, as constants are.

Of 1,969 different names of 20 characters or more in Python's library 90 % stay under the threshold (most others are
numbers; a pangram such as the-quick-brown-fox-jumps-over can pass it); of random strings some 5 % of 20 to 24 characters
do, and 1 to 3 % of 40.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import map_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: A run of 24 is a run of one or more that is long enough.
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN = 6
CANDIDATE_MIN = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
#: Signs that stand between a sensitive word and a key in the same run.
BETWEEN = "=-_/+."
SENSITIVE = re.compile(r"password|passwd|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|signature|client.?id|session.?id", re.ASCII | re.IGNORECASE)
#: Parts of the sensitive words, one of which a text must hold before the pattern is tried.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "signature", "client", "session")
#: Characters of a candidate up to which the thorough level of the compressor is used, and the two levels.
THOROUGH, LEVELS = 4000, (19, 3)
#: What stands between the parts of names.
SEPARATORS = re.compile(r"[-_/.=+]+")
#: Characters before a candidate that can hold the sensitive word, and around it that prime the compressor.
REACH, AROUND = 48, 400
#: Novelty that is reported, by length: the share of chance shrinks.
NOVELTY = ((100, 1.12), (1000, 1.05), (1 << 62, 0.97))
#: Identifiers that are common near keys in code and settings.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret authorization bearer credential "
    "session_id signature username username_or_email database hostname localhost configuration environment settings request response headers content "
    "application/json application/x-www-form-urlencoded http https example.com return function import export const string default value null true false "
    "connection endpoint bucket region account identifier created_at updated_at description documentation placeholder your_api_key_here changeme "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx XXXXXXXX ********"
)


#: Ordinary text before every candidate, by which the compressor learns what letters, digits and signs cost.
ORDINARY = (
    "The order of invoice-2023 was sent on March 14 to the main office, and the report of January 2019 is in archive/reports/q4/summary.txt. "
    "See docs/guide/chapter-3 or README.md; run setup.py, then make install. MaxRetryCount, HttpClient and UserProfileService are classes; first_name, last_name, "
    "page_size and total_amount are columns. A team from New York works with partners in Berlin, Madrid and Paris. Version 2.10.5 replaces 1.8.0 since July 2021. "
    "customer_history product-catalog shipping_address backup/daily/2024-01-30 feature/login-page fix_bug_1042 module7 test_case_12 user42 part-9 step6 v3 "
    "Every child knows which questions to ask, although few of them would have given just an answer; it makes people think about what they need before they begin. "
    "int main(void) { for (i = 0; i < 256; i++) sum += data[i] * 8; } public static void MAIN if else while try catch BUILD_TYPE LOG_LEVEL "
    "Le client, der Kunde, el usuario, una nueva cuenta por favor, nicht mehr als 100 Zeichen, pour la premi re fois, schlie lich, desde hace mucho tiempo. "
)


def _base(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the three fixed kinds; ``low`` is the text in lower case."""
    out = []
    if any(word in low for word in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _plain(string: str) -> tuple[str, float]:
    """The string as it is measured, and the bits that its alphabet holds."""
    plain = SEPARATORS.sub(" ", string)
    small, large, digits = any(c.islower() for c in plain), any(c.isupper() for c in plain), any(c.isdigit() for c in plain)
    if not small:
        plain = plain.lower()
    if digits and all(c in "0123456789abcdef " for c in plain):
        signs = 16 if small or large else 10
    else:
        signs = 26 * max(1, small + large) + 10 * digits
    return plain, len(plain) * log2(signs)


def novelty(text: str, start: int, end: int) -> float:
    """Marginal bytes of text[start:end] against the identifiers and what is around it, by what its alphabet holds."""
    import zstandard

    around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
    plain, bits = _plain(text[start:end])
    known = zstandard.ZstdCompressionDict(f"{around} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed = zstandard.ZstdCompressor(level=LEVELS[len(plain) > THOROUGH], dict_data=known, write_content_size=False)
    before = ORDINARY.encode()
    return (len(primed.compress(before + plain.encode())) - len(primed.compress(before))) * 8 / bits


def novel(text: str, start: int, end: int) -> bool:
    """Whether a candidate is too new to be ordinary."""
    return novelty(text, start, end) >= next(least for length, least in NOVELTY if end - start < length)


def _starts(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate, one of a run at most.

    A run within reach of a sensitive word before it is one from its start.  Else, if words lie in it, it counts from
    behind the last of them, and the signs that follow, that leaves enough.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    out, k = [], 0
    for run in CANDIDATE.finditer(text) if words else ():
        a, e = run.span()
        if e - a < CANDIDATE_MIN:
            continue
        while k < len(words) and words[k][1] <= a:  # the last word that ends before the run
            k += 1
        if k and a - words[k - 1][1] <= REACH:
            out.append((a, e))
            continue
        inside, start = k, None
        while inside < len(words) and words[inside][1] <= e - CANDIDATE_MIN:
            start = words[inside][1]
            inside += 1
        if start is not None:
            while start < e and text[start] in BETWEEN:
                start += 1
            if e - start >= CANDIDATE_MIN:
                out.append((start, e))
    return out


def _novel(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span and don't compress.  Each run is measured once, so time is linear in the text."""
    taken = sorted((a, e) for a, _, e in base)
    out = []
    for a, e in _starts(text):
        at = bisect_right(taken, (a, len(text)))  # spans of one text don't overlap, so the neighbours tell
        free = (not at or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= e)
        if free and novel(text, a, e):
            out.append((a, 3, e))
    return out


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text by start, then kind; code points, end exclusive.  Null: none."""
    if not text:
        return []
    low = text.lower()
    base = _base(text, low)
    return [(KINDS[k], a, e) for a, k, e in sorted(base + (_novel(text, base) if any(h in low for h in HINTS) else []))]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found ARRAY<STRUCT<kind, start, end>>) of every row, whole texts.

    Null and empty texts have none.  Rows are kept one for one, with null and repeated ids; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("found", T.ArrayType(SPAN))])

    def run(b: dict[str, list]) -> dict[str, list]:
        return {"doc_id": b["doc_id"], "found": [[dict(zip(SPAN.names, s, strict=True)) for s in scan_text(t)] for t in b["text"]]}

    return map_batches(rows, run, schema).withColumnRenamed("doc_id", id_col)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of what ``scan`` returns."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select(id_col, *[count(k) for k in KINDS[:3]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
