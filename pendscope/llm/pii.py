"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each value found is validated (check digits, calendar, ranges), written as a number of the values its format allows, permuted
by a keyed Feistel network and written back in the same format. Equal values get equal pseudonyms in every document, however
they are written: a date day first or year first, a card with or without blanks, an address in capitals, a phone number
behind + or 00 are permuted as the bare value. (A date that can only be read month first stays such a date and is linked to
its like alone.) Different values get different pseudonyms, no value keeps its own, and whoever has the key can undo it.

The key is an argument without a default. The queries take it from the setting ``KEY_SETTING``; where that is unset, a
random one is made once and kept in the shared folder, so that pseudonyms stay linked between jobs."""

from __future__ import annotations

import ipaddress
import re
import secrets
from bisect import bisect_left
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pendscope.llm.common import shared_folder

KEY_SETTING = "spark.pendscope.pii.key"
ROUNDS = 8
KINDS = ("email", "iban", "card", "ip", "date", "ssn", "phone")  # where two overlap the earlier kind wins
_MAYBE = re.compile(r"[0-9]{2}|@|[0-9][./][0-9]|[0-9]{4}-[0-9]|:[0-9A-Fa-f]{0,4}:")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_PATTERNS = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "ip6": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:]|\.[0-9])"),
    "date": re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/]|-[0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
                        r"|(?<![0-9A-Za-z+.,-])(?:\+|00)[1-9](?:[ ./-]?(?:\([0-9]{1,4}\) ?)?[0-9]){6,14}(?![0-9])"),
}
# fixed values: country codes of one and of two digits; all others have three
_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54",
          "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
# fixed values: lengths of account numbers by country
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_LATE = [n for n in range(_DAYS) if (_FIRST_DAY + timedelta(n)).day > 12]  # month first is read only for these


def feistel(value: int, size: int, kind: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced network over the next even number of bits, walked until the value lies
    inside again."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for turn in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)):
            source = left if back else right
            text = b"%d|%d|" % (turn, size) + kind.encode() + b"|" + source.to_bytes(width, "big")
            mixed = b"".join(blake2b(text + bytes([part]), key=key, digest_size=64).digest() for part in range(width // 64 + 1))
            turned = (right if back else left) ^ (int.from_bytes(mixed[:width], "big") & mask)
            left, right = (turned, left) if back else (right, turned)
        value = left << half | right
        if value < size:
            return value


def permuted(value: int, size: int, kind: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation without fixed points: into the network's order, a keyed number of steps round, and back."""
    if size < 2:
        return value
    steps = 1 + int.from_bytes(blake2b(b"%d|" % size + kind.encode(), key=key, digest_size=16).digest(), "big") % (size - 1)
    inside = (feistel(value, size, kind, key) + (-steps if back else steps)) % size
    return feistel(inside, size, kind, key, back=True)


def stored_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, or the one that the shared folder keeps; made there if it keeps none."""
    if known := spark.conf.get(KEY_SETTING, None):
        return known.encode()
    jvm, folder = spark._jvm, f"{shared_folder(spark)}/pii-key"
    if not jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
        spark.createDataFrame([(secrets.token_hex(32),)], "value string").coalesce(1).write.mode("overwrite").text(folder)
    return spark.read.text(folder).first()["value"].encode()


def _letters(text: str, kind: str, key: bytes, back: bool) -> str:
    """Permutes all ASCII letters and digits of a text as one number, each within its class; other characters stay."""
    classes = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) for c in text if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for c, (first, base) in zip((c for c in text if c.isascii() and c.isalnum()), classes):
        value, size = value * base + ord(c) - ord(first), size * base
    value = permuted(value, size, kind, key, back)
    out = []
    for first, base in reversed(classes):
        value, digit = divmod(value, base)
        out.append(chr(ord(first) + digit))
    return "".join(out.pop() if c.isascii() and c.isalnum() else c for c in text)


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _fill(form: str, characters: str) -> str:
    """``form`` with its letters and digits replaced in turn."""
    fresh = iter(characters)
    return "".join(next(fresh) if c.isalnum() else c for c in form)


def _iban_checks(bare: str) -> str:
    spelled = "".join(str(int(c, 36)) for c in bare[4:] + bare[:2] + "00")
    return f"{98 - int(spelled) % 97:02d}"


def _date_of(text: str) -> tuple[date, str] | None:
    """A date and its form. Day first; where that is no date, month first."""
    forms = ("YMD",) if len(re.split("[-./]", text)[0]) == 4 else ("DMY", "MDY")
    for form in forms:
        parts = dict(zip(form, re.split("[-./]", text)))
        try:
            found = date(int(parts["Y"]), int(parts["M"]), int(parts["D"]))
        except ValueError:
            continue
        if 0 <= (found - _FIRST_DAY).days < _DAYS:
            return found, form
    return None


def _in_case_of(text: str, form: str) -> str:
    return "".join(c.upper() if f.isupper() else c for c, f in zip(text, form))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The country code stays and the digits behind it are permuted as one number; without a code, all digits are."""
    digits = re.sub("[^0-9]", "", text)
    prefix = 2 if text.startswith("00") else 0
    if not prefix and not text.startswith("+"):
        return _fill(text, _letters(digits, "phone", key, back))
    code = next((c for c in (digits[prefix:prefix + 1], digits[prefix:prefix + 2]) if c in _CODES), digits[prefix:prefix + 3])
    rest = digits[prefix + len(code):]
    if not 4 <= len(rest) <= 15 - len(code):
        return None
    return _fill(text, digits[:prefix] + code + _letters(rest, f"phone{code}", key, back))


@lru_cache(100_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value (with ``back``, the value of a pseudonym); None where it is not valid. A date with a part of
    one digit comes back with its parts as short as they go."""
    bare = re.sub("[^A-Za-z0-9]", "", text)
    if kind == "email":
        local, _, domain = text.partition("@")
        rest, _, last = domain.rpartition(".")
        small = f"{_letters(local.lower(), 'local', key, back)}@{_letters(rest.lower(), 'domain', key, back)}"
        return f"{_in_case_of(small, text)}.{last}"
    if kind == "card":
        if luhn_digit(bare[:-1]) != bare[-1] or len(set(bare)) == 1:
            return None
        body = _letters(bare[:-1], "card", key, back)
        return _fill(text, body + luhn_digit(body))
    if kind == "iban":
        if not 15 <= len(bare) <= 34 or _iban_checks(bare) != bare[2:4]:
            return None
        bare = bare[:2] + "00" + _letters(bare[4:], "iban" + bare[:2], key, back)
        return _fill(text, bare[:2] + _iban_checks(bare) + bare[4:])
    if kind == "ip" and ":" in text:
        try:
            value = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        if not any(c.isdigit() for c in text):
            return None
        return str(ipaddress.IPv6Address(permuted(value, 1 << 128, "ip6", key, back)))
    if kind == "ip":
        octets = list(map(int, text.split(".")))
        if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        value = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip", key, back)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "date":
        found = _date_of(text)
        if found is None:
            return None
        number = (found[0] - _FIRST_DAY).days
        if found[1] == "MDY":
            number = _LATE[permuted(bisect_left(_LATE, number), len(_LATE), "late", key, back)]
        else:
            number = permuted(number, _DAYS, "date", key, back)
        day = _FIRST_DAY + timedelta(number)
        width = 1 if any(len(part) == 1 for part in re.split("[-./]", text)) else 2
        parts = {"Y": f"{day.year:04d}", "M": f"{day.month:0{width}d}", "D": f"{day.day:0{width}d}"}
        marks = re.findall("[-./]", text)
        return "".join(parts[p] + mark for p, mark in zip(found[1], [*marks, ""]))
    if kind == "ssn":
        area, group, serial = int(bare[:3]), int(bare[3:5]), int(bare[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(permuted(value, 898 * 99 * 9999, "ssn", key, back), 9999)
        area, group = divmod(value, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    return _phone(text, key, back)


def _ibans(text: str, key: bytes) -> list[tuple[int, int]]:
    """Places of valid account numbers. A match may take in words that follow, so it is also read up to each of its blanks:
    the reading of its country's length first, then the longest. The search goes on behind the reading taken."""
    found, match = [], _PATTERNS["iban"].search(text)
    while match:
        start, stop = match.span()
        ends = [stop, *(k for k in range(stop - 1, start, -1) if text[k] == " ")]
        length = _IBAN_LENGTHS.get(text[start:start + 2], 0)
        ends.sort(key=lambda end: end - start - text.count(" ", start, end) != length)
        end = next((end for end in ends if pseudonym("iban", text[start:end], key) is not None), None)
        if end is not None:
            found.append((start, end))
        match = _PATTERNS["iban"].search(text, start + 1 if end is None else end)
    return found


def found_in(text: str, key: bytes) -> list[tuple[int, int, str]]:
    """Places of possible values: (start, stop, kind), in order, without overlaps."""
    if not _MAYBE.search(text):
        return []
    spots = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain and any(c.isalnum() for c in local[0]):
            spots.append((0, local.start(), domain.end(), "email"))
        at = text.find("@", at + 1)
    for rank, kind in enumerate(KINDS[1:], 1):
        if kind == "iban":
            spots += [(rank, start, stop, kind) for start, stop in _ibans(text, key)]
            continue
        for pattern in (kind, "ip6") if kind == "ip" else (kind,):
            spots += [(rank, m.start(), m.end(), kind) for m in _PATTERNS[pattern].finditer(text) if pseudonym(kind, m[0], key) is not None]
    taken: list[tuple[int, int, str]] = []
    if len(spots) < 2:
        return [spot[1:] for spot in spots]
    ends: dict[int, bool] = {}
    for _, start, stop, kind in sorted(spots):
        if not any(k in ends for k in range(start, stop)):
            ends.update(dict.fromkeys(range(start, stop), True))
            taken.append((start, stop, kind))
    return sorted(taken)


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms (None if nothing was found) and the places of the values. The pseudonym of a
    network address may be longer or shorter than it; places refer to the text given."""
    spots = found_in(text, key) if text else []
    if not spots:
        return None, []
    out, at = [], 0
    for start, stop, kind in spots:
        out += [text[at:start], pseudonym(kind, text[start:stop], key)]
        at = stop
    return "".join(out) + text[at:], spots


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and a column ``pii``, the places as ``kind:start:stop``, comma-joined.

    Null and empty texts stay as they are; repeated rows change alike; every other column is kept, but for one named ``pii``,
    which is replaced. Only changed texts come back from Python. Nothing is shuffled or collected."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("pii", T.StringType())])

    @F.pandas_udf(kind)
    def change(texts: pd.Series) -> pd.DataFrame:
        done = [replaced(x, key) for x in texts]
        return pd.DataFrame({"text": pd.Series([x for x, _ in done], dtype=object),
                             "pii": [",".join(f"{k}:{a}:{b}" for a, b, k in spots) for _, spots in done]})

    kept = [c for c in docs.columns if c.lower() != "pii"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), change(F.col(text)).alias("changed"))
    return rows.select(*(F.coalesce("changed.text", f"doc.`{c}`").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in kept),
                       F.col("changed.pii").alias("pii"))


def pii_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    counts = [F.expr(f"bigint(size(filter(split(pii, ','), x -> startswith(x, '{kind}:'))))").alias(f"n_{kind}") for kind in KINDS]
    return pseudonymise(docs.select("doc_id", "text"), key).select("doc_id", "text", "pii", *counts)


def pseudonymised_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """Pseudonyms in all texts, with the columns of ``docs``; ``n_chars`` counts the new text."""
    changed = pseudonymise(docs.withColumnRenamed("pii", "pii "), key).drop("pii").withColumnRenamed("pii ", "pii")
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
