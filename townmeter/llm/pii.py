"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townmeter.llm.common import small_batches

#: Kinds in the order of reports; the first four are the base, the others are added by the scores below.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
#: Score of a proposed span, what a passed checksum or a context word nearby adds, and the score it needs. A failed checksum vetoes.
PRIOR = {"iban": 0.3, "small_iban": 0.0, "ssn": 0.3, "dni": 0.2, "insee": 0.3, "steuer": 0.0, "secret": 0.4, "assigned": 0.4, "prefixed": 0.6, "jwt": 0.3}
CHECKED, NEARBY, NEEDED = 0.5, 0.3, 0.6
#: Code points before and after a span in which context words count.
REACH = 40

# Context words by kind, and lengths of account numbers by country.
CONTEXT = {
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "national_id": ("ssn", "social security", "national id", "tax id", "passport", "steuer", "sozialversicherung", "insee", "sécurité sociale", "dni", "nif", "nie"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "access_key", "accesskey", "secretkey", "accesstoken", "authtoken"),
}
# What secrets of well-known services begin with, and the shape of what follows.
PREFIXES = (
    "(?:AKIA|ASIA)[A-Z2-7]{16}", "gh[opsru]_[A-Za-z0-9]{36,}+", "github_pat_[A-Za-z0-9_]{22,}+", "glpat-[A-Za-z0-9_-]{20,}+", "AIza[A-Za-z0-9_-]{35}",
    "[prs]k_(?:live|test)_[A-Za-z0-9]{16,}+", "xox[abprs]-[A-Za-z0-9-]{10,}+", "npm_[A-Za-z0-9]{36}", "pypi-[A-Za-z0-9_-]{50,}+",
)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Possessive runs and look-behinds keep the work linear in the text; matches are the greedy leftmost ones.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,28}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DNI = re.compile(r"(?<![A-Za-z0-9])[XYZ0-9][0-9]{7}-?[A-Z](?![A-Za-z0-9])")
_INSEE = re.compile(r"(?<![A-Za-z0-9])[12] ?[0-9]{2} ?[0-9]{2} ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![A-Za-z0-9])")
_STEUER = re.compile(r"(?<![A-Za-z0-9])[1-9][0-9](?: ?[0-9]{3}){3}(?![A-Za-z0-9])")
_SMALL_IBAN = re.compile(r"(?<![A-Za-z0-9])([a-z]{2})[0-9]{2}(?: ?[a-z0-9]){11,28}")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9_-])(?:{'|'.join(PREFIXES)})(?![A-Za-z0-9_-])")
_ASSIGNED = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9_!@#$%^&*+=~/-]{8,}+)(?![.(\[])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
#: Context words stand alone, in any case, in the singular or with an s; an underscore parts words.
_AROUND = {k: re.compile(rf"(?i)(?<![^\W_])(?:{'|'.join(map(re.escape, words))})s?(?![^\W_])") for k, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 on division by 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def dni(number: str) -> bool:
    """Whether the letter of a Spanish number fits its digits, of which X, Y, Z stand for 0, 1, 2."""
    digits = number[:-1].replace("-", "").translate(str.maketrans("XYZ", "012"))
    return _DNI_LETTERS[int(digits) % 23] == number[-1]


def insee(number: str) -> bool:
    """Whether the last two digits of a French number are 97 minus the remainder of the others modulo 97; 2A and 2B in them count as 19 and 18."""
    n = number.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return 97 - int(n[:-2]) % 97 == int(n[-2:])


def steuer(number: str) -> bool:
    """Whether the last digit of a German tax number is its check digit modulo 11 and 10."""
    *digits, last = map(int, number.replace(" ", ""))
    product = 10
    for d in digits:
        product = 2 * ((d + product) % 10 or 10) % 11
    return (11 - product) % 10 == last


def jwt(token: str) -> bool:
    """Whether the first part of a web token is a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match ends its local part at an @, so each @ is tried with the run of letters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """email, ip, card and phone spans: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _near(text: str, start: int, end: int, kind: str) -> bool:
    """Whether a context word lies whole within REACH code points before or after the span."""
    if _AROUND[kind].search(text, max(0, start - REACH), start):
        return True
    after = _AROUND[kind].search(text, end, end + REACH + 1)
    return after is not None and after.end() <= end + REACH


def _account(written: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Account numbers as long as their country's; the match may have gone further."""
    for m in written.finditer(text):
        country = m[1].upper()
        left, end = IBAN_LENGTHS.get(country, 0), m.start()
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        if left == 0 and country in IBAN_LENGTHS and not (text[end : end + 1].isalnum()):
            yield m.start(), end


def _mixed(found: str) -> bool:
    return bool(re.search("[0-9]", found) and re.search("[A-Za-z]", found))


#: (kind, prior, what proposes spans, what confirms them).
PROPOSED = (
    ("iban", "iban", lambda t: _account(_IBAN, t), lambda s: mod97(s.replace(" ", ""))),
    ("iban", "small_iban", lambda t: _account(_SMALL_IBAN, t), lambda s: mod97(s.replace(" ", ""))),
    ("national_id", "ssn", lambda t: (m.span() for m in _SSN.finditer(t)), None),
    ("national_id", "dni", lambda t: (m.span() for m in _DNI.finditer(t)), dni),
    ("national_id", "insee", lambda t: (m.span() for m in _INSEE.finditer(t)), insee),
    ("national_id", "steuer", lambda t: (m.span() for m in _STEUER.finditer(t)), steuer),
    ("secret", "secret", lambda t: (m.span() for m in _SECRET.finditer(t) if _mixed(m[0])), None),
    ("secret", "assigned", lambda t: (m.span(1) for m in _ASSIGNED.finditer(t) if _mixed(m[1])), None),
    ("secret", "prefixed", lambda t: (m.span() for m in _PREFIXED.finditer(t)), None),
    ("secret", "jwt", lambda t: (m.span() for m in _JWT.finditer(t)), jwt),
)


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the other kinds whose score reaches NEEDED: the prior, plus the checksum's and the context's share; a checksum that fails rules a span out.

    Overlapping spans of one kind become one. All but some prefixed secrets and web tokens hold a digit.
    """
    found = set()
    for kind, prior, propose, check in PROPOSED:
        for a, b in propose(text):
            if check and not check(text[a:b]):
                continue
            if PRIOR[prior] + CHECKED * bool(check) + NEARBY * _near(text, a, b, kind) >= NEEDED - 1e-9:
                found.add((KINDS.index(kind), a, b))
    out: list[tuple[str, int, int]] = []
    for k, a, b in sorted(found):
        if out and out[-1][0] == KINDS[k] and a < out[-1][2]:
            out[-1] = (KINDS[k], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((KINDS[k], a, b))
    return out


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by kind and start."""
    base = base_spans(text)
    return base, base + added_spans(text)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first one's kind."""
    out, done = [], 0
    for start, end, _, kind in sorted((a, b, KINDS.index(k), k) for k, a, b in found):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, base_sha, written = {k: [] for k in KINDS[:4]}, [], []
        for text in batch.column(1).to_pylist():
            base, all_ = spans(text or "")
            for k in counts:
                counts[k].append(sum(x[0] == k for x in base))
            base_sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
            written.append(_written(all_))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(v, pa.int64()) for v in counts.values()], pa.array(base_sha, pa.string()), pa.array(written, pa.string())],
            ["id", *[f"n_{k}" for k in counts], "base_sha256", "spans"],
        )


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Whole texts, a null text is empty. Spans are kind:start:end in code points, the end
    exclusive, by kind in the order of KINDS and then by start. Repeated rows give equal rows, an
    empty table an empty one; the key may be null and of any type; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_report, schema).withColumnRenamed("id", key)


def mask_pii(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with every span of personal data replaced by its kind, with all columns, whatever their names.

    `length`, if there, becomes the new text's code points. Null texts stay null, empty ones
    empty, and texts without personal data as they are. Repeated rows give equal rows, an empty
    table an empty one. Very long texts are searched whole, in linear time.
    """
    small_batches(docs.sparkSession)
    rest = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(docs.columns, 1) if c != text])
    packed = docs.select(rest.alias("row"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else masked(t, spans(t)[1]) for t in batch.column(1).to_pylist()]
            yield batch.set_column(1, batch.schema.field(1), pa.array(new, batch.schema.field(1).type))

    out = packed.mapInArrow(run, packed.schema)
    value = {text: F.col("t")} | ({length: F.length("t").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*[value.get(c, F.col("row")[str(i)]).alias(c) for i, c in enumerate(docs.columns, 1)])
