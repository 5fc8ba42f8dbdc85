"""Surrogates for personal data and secrets.

Entities are found by patterns, in whole texts. Each has a canonical form, without case and
separators, so every spelling of an address, a number or a name is one entity; of a name each part
is one, and where a text names a part again, without a title, that is found too (coreference). The
surrogate is a keyed format-preserving cipher of the canonical form: each character goes to one
of its own class (digit, vowel, consonant, or its Unicode block's letters of the same script and case),
by a Feistel network over the mixed radices of the classes; the spelling's case and separators are laid on
afterwards. So type, script, length and punctuation stay, and a number that passes the Luhn check
passes it again. A name keeps what tells its gender: the title before it, and each part's last letter.
The cipher is a bijection within a type and canonical format, so different entities stay different.

A surrogate may still be some other real entity. That is checked over the whole corpus: the
distinct entities are joined with all surrogates, and those in conflict get the surrogate of a
next attempt until none is left. When the attempts in a value's own format run out (at once where it has
no character of any class), its surrogate is a keyed draw that is some characters longer, and longer
with every few attempts; should that not be enough either, the query fails. These exceptions are
broadcast if few (checked); otherwise each document's own are joined to it.

Results for edge cases: a null text stays null, an empty one empty; a text without entities
is unchanged; overlapping finds are settled by the earlier, then the longer one; repeated rows are
changed alike; other columns, clashing names included, stay; a text may be of any length.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, spread, table, tune, written

#: A key for tests and queries; give your own, and keep it secret.
DEMO_KEY = b"deltaloom demonstration key"
#: Exceptions that fit a broadcast; with more, each document's own are joined to it.
BROADCAST_EXCEPTIONS = 100_000
ROUNDS = 8
#: Attempts in a value's own format; the later ones are in wider formats, some for each width.
FORMAT_ATTEMPTS = 8
WIDTH_ATTEMPTS = 2
WIDTHS = 32

#: Titles; they stay, and with them the gender that they tell.
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Mx", "Sir", "Lady", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora",
    "Sr", "Sra", "Don", "Doña", "Monsieur", "Madame", "Mme", "Mlle", "Господин", "Госпожа", "Κύριος", "Κυρία",
)
#: Phrases that a name follows.
CUES = (
    "[Mm]y name is", "[Ff]ull name:", "[Ff]irst name:", "[Ll]ast name:", "[Ss]urname:", "[Mm]ein Name ist", "[Ii]ch hei(?:ß|ss)e", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Mm]i nombre es",
    "[Mm]i chiamo", "[Мм]еня зовут", "[Rr]egards,", "[Ss]incerely,", "[Gg]rüßen",
)
_NAME = r"(?:[^\W\d_a-zа-яα-ω]['’])?[^\W\d_a-zа-яα-ω][^\W\d_]+(?:['’](?!s\b)[^\W\d_]+)?"
_TITLED = rf"(?:(?:{'|'.join(TITLES)})\.? )+(?:[^\W\d_a-z]\. ?){{0,2}}"
_NAMES = rf"{_NAME}(?:[ -]{_NAME}){{0,2}}"
#: A key word with what stands around it: client_secret, DB_PASSWORD, auth-key-2, accessToken; but not author or tokenizer.
_SECRET_KEY = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)(?i:s|\d+)?(?:[_-][\w-]*|(?<=[a-z])[A-Z]\w*)?(?!\w)"
#: How keys of common services begin.
_KEY = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-(?:[a-z]+-)?|[sr]k_live_|xox[abprs]-|AIza|npm_|hf_|eyJ)"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.%+-]+@[^\W_](?:[\w-]*\w)?(?:\.[^\W_](?:[\w-]*\w)?)+")),
    ("secret", re.compile(rf"""{_SECRET_KEY}["']?\s*[=:]\s*(?:"((?:\\.|[^"\\\n]){{8,}})"|'((?:\\.|[^'\\\n]){{8,}})'|["']([^\s"']{{8,}})|([^\s"']\S{{7,}}))""")),
    ("secret", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*([^-]{8,}?)\s*-----END")),
    ("secret", re.compile(rf"(?<![\w-]){_KEY}((?=[\w.-]*\d)[\w-]{{14,}}(?:\.[\w-]+)*)")),
    ("hex", re.compile(r"(?<![\w-])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[23][0-9A-Fa-f]{3}|[Ff][CcDdEe][0-9A-Fa-f]{2}):[0-9A-Fa-f:]{2,34})(?![\w:]|\.\d)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("number", re.compile(r"(?<!\w)(?<!\d[.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|-\d)")),
    ("ssn", re.compile(r"(?<!\w)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\w|-\d)")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{7,15}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?i:\b(?:call|phone|tel|telephone|mobile|cell|fax)\b[.:]?(?: me| us)?(?: at| on)?) ?(\d{3}[ .-]\d{4})(?!\w|[.-]\d)")),
    ("name", re.compile(rf"(?<!\w)(?:{_TITLED}|(?:{'|'.join(CUES)})\s+(?!(?:{'|'.join(TITLES)})\b))({_NAMES})")),
)
_DIGIT = re.compile(r"\d")
_LEADS_NAME = re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.? |{'|'.join(CUES)})")
_SECRET = re.compile(r"(?i)token|secret|passw|key|auth")
_PART = re.compile(_NAME)

#: Classes whose characters stand for each other.
_CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåèéêëìíîïòóôõöùúûü", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ",
    "аеиоуэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
_HEX = "0123456789abcdef"
_AT = {c: (own, i) for own in _CLASSES for i, c in enumerate(own)}
#: Code points that a class of other letters is taken from.
_BLOCK = 128


def _sort_of(c: str) -> tuple:
    """Category, script and whether the other case is one letter and leads back: what a class of letters has in common."""
    kind = unicodedata.category(c)
    other = c.upper() if kind == "Ll" else c.lower()
    return kind, unicodedata.name(c, "").split(" ")[0], len(other) == 1 and (other.lower() if kind == "Ll" else other.upper()) == c


@lru_cache(1 << 16)
def place(c: str) -> tuple[str, int] | None:
    """The class of a letter or digit, as all its characters, and its place there; None for what stays."""
    if c in _AT:
        return _AT[c]
    own = _sort_of(c)
    if own[0][0] != "L" and own[0] != "Nd":
        return None
    first = ord(c) - ord(c) % _BLOCK
    members = "".join(x for x in map(chr, range(first, first + _BLOCK)) if x not in _AT and _sort_of(x) == own)
    return members, members.index(c)


def feistel(symbols: list[int], radices: list[int], key: bytes, tweak: bytes) -> list[int]:
    """A keyed bijection of ``symbols``, each below its radix."""
    m = (len(symbols) + 1) // 2

    def number(s: list[int], r: list[int]) -> tuple[int, int]:
        n, size = 0, 1
        for x, y in zip(s, r, strict=True):
            n, size = n * y + x, size * y
        return n, size

    left, left_size = number(symbols[:m], radices[:m])
    right, right_size = number(symbols[m:], radices[m:])
    for i in range(ROUNDS):
        other = right if i % 2 == 0 else left
        f = int.from_bytes(hashlib.blake2b(b"%d|%d|%s" % (i, other, tweak), key=key[:64], digest_size=64).digest())
        if i % 2 == 0:
            left = (left + f) % left_size
        else:
            right = (right + f) % right_size
    out: list[int] = []
    for n, r in ((right, radices[m:]), (left, radices[:m])):
        for y in reversed(r):
            out.append(n % y)
            n //= y
    return out[::-1]


def luhn(digits: list[int]) -> int:
    """The sum of the Luhn check, by ten."""
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


def canonical(kind: str, value: str) -> str:
    """What all spellings of an entity have in common."""
    if kind in ("email", "name"):
        return "".join(map(_lower, value))
    if kind in ("number", "ssn", "phone"):
        return "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded.replace(":", "") if ":" in value else value
    return value


def _laid_on(kind: str, value: str, new: str, extra: str) -> str:
    """A surrogate in the spelling of ``value``: its separators and its case."""
    if kind == "ip":
        return new
    if kind == "ipv6":
        return ":".join(f"{int(new[i : i + 4], 16):x}" for i in range(0, 32, 4)) if ":" in value else new
    at, out, i = _widens_at(kind, canonical(kind, value)), [], 0
    own = (lambda c: c.isdigit()) if kind in ("number", "ssn", "phone") else (lambda c: c != " ") if kind == "iban" else (lambda c: True)
    upper = kind in ("email", "name")
    for c in value:
        if not own(c):
            out.append(c)
            continue
        if i == at:
            out.append(extra.upper() if upper and value.isupper() and len(value) > 1 else extra)
        out.append(new[i].upper() if upper and _lower(c) != c else new[i])
        i += 1
    return "".join(out) + (extra if at >= i else "")


def _widens_at(kind: str, value: str) -> int:
    """Where a wider surrogate has its further characters: before a name's last letter, else behind the first word."""
    if kind == "name":
        return len(value) - 1
    word = re.search(r"[^\W_]+", value)
    return word.end() if word else len(value)


def _fixed(kind: str, value: str) -> set[int]:
    """Places that stay: a name's last letter, an address' last domain."""
    if kind == "name":
        return {len(value) - 1}
    return set(range(value.rindex("."), len(value))) if kind == "email" else set()


def _classes(kind: str, value: str) -> list[tuple[str, int] | None]:
    if kind in ("hex", "ipv6") or kind == "secret" and all(c in _HEX for c in value):
        return [(_HEX, _HEX.index(c)) for c in value]
    fixed = _fixed(kind, value)
    return [None if i in fixed or (p := place(c)) is None or len(p[0]) < 2 else p for i, c in enumerate(value)]


def _ciphered(kind: str, value: str, key: bytes, attempt: int) -> str:
    places = _classes(kind, value)
    if not any(places):
        return value
    form = "".join(c if p is None else f"\x00{p[0][0]}{len(p[0])}" for c, p in zip(value, places, strict=True))
    new = iter(feistel([p[1] for p in places if p], [len(p[0]) for p in places if p], key, f"{kind}|{attempt}|{form}".encode()))
    return "".join(c if p is None else p[0][next(new)] for c, p in zip(value, places, strict=True))


def _widened(kind: str, value: str, key: bytes, attempt: int, width: int) -> tuple[str, str]:
    """A keyed draw: each character for one of its class, those of no class for a letter, and ``width`` more of the sort of those before them."""
    seed = hashlib.blake2b(f"wide|{kind}|{attempt}|{value}".encode(), key=key[:64]).digest()
    fixed = _fixed(kind, value) if kind in ("email", "name") and len(value) > 1 else ()
    draws = iter(hashlib.shake_256(seed).digest(8 * (len(value) + width)))
    word = re.search(r"[^\W_]", value)

    def draw(c: str) -> str:
        n = int.from_bytes(bytes(next(draws) for _ in range(8)))
        found = place(c)
        if found and len(found[0]) > 1:
            return found[0][n % len(found[0])]
        return _CLASSES[2][n % len(_CLASSES[2])] if c.isalnum() or not word else c

    at = _widens_at(kind, value)
    more = "".join(draw(value[max(0, at - 1)]) for _ in range(width))
    return "".join(c if i in fixed else draw(c) for i, c in enumerate(value)), more


@lru_cache(1 << 14)
def cipher(kind: str, value: str, key: bytes, attempt: int) -> tuple[str, str]:
    """The surrogate of a canonical form, and the further characters of a wider one."""
    if kind not in ("ip", "ipv6", "number") and (attempt > FORMAT_ATTEMPTS or not any(_classes(kind, value))):  # those have room for every corpus
        return _widened(kind, value, key, attempt, 1 + max(0, attempt - FORMAT_ATTEMPTS - 1) // WIDTH_ATTEMPTS)
    if kind == "ip":
        octets = value.split(".")
        if all(str(int(o)) == o for o in octets):
            return ".".join(map(str, feistel([int(o) for o in octets], [256] * 4, key, f"ip|{attempt}".encode()))), ""
    if kind == "number":
        was = luhn([int(c) for c in value])
        new = _ciphered("digits", value[:-1], key, 10 * attempt + was)
        return f"{new}{(was - luhn([*map(int, new), 0])) % 10}", ""
    return _ciphered(kind, value, key, attempt), ""


def whole_surrogate(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The surrogate of a canonical form, as it is compared with other entities."""
    new, extra = cipher(kind, value, key, attempt)
    at = _widens_at(kind, value)
    return new[:at] + extra + new[at:] if extra else new


def surrogate(kind: str, value: str, key: bytes = DEMO_KEY, attempt: int = 0) -> str:
    """The surrogate of an entity in its spelling, of its own type and format, or after FORMAT_ATTEMPTS of a wider one."""
    return _laid_on(kind, value, *cipher(kind, canonical(kind, value), key, attempt))


def _real_ipv6(value: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, not overlapping; a name's parts are entities of their own, wherever the text has them."""
    if not text:
        return []
    found: list[tuple[int, int, int, str]] = []
    digits = _DIGIT.search(text) is not None
    runs = {
        "email": "@" in text,
        "name": _LEADS_NAME.search(text) is not None,
        "secret": ("=" in text or ":" in text) and _SECRET.search(text) is not None or digits or "PRIVATE KEY" in text,
        "ipv6": digits and text.count(":") > 1,
    }
    names: set[str] = set()
    for rank, (kind, pattern) in enumerate(PATTERNS):
        if not runs.get(kind, digits):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if kind == "name":
                for part in _PART.finditer(text, a, b):
                    found.append((part.start(), -part.end(), rank, kind))
                    names.add(part[0])
            elif kind != "ipv6" or _real_ipv6(text[a:b]):
                found.append((a, -b, rank, kind))
    if names:
        again = sorted({form for n in names for form in (n, n.upper())}, key=len, reverse=True)
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, again))})(?!\w)", text):
            found.append((m.start(), -m.end(), len(PATTERNS), "name"))
    out, end = [], 0
    for a, b, _, kind in sorted(found):
        if a >= end:
            out.append((a, -b, kind))
            end = -b
    return out


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """The text with surrogates, and how many."""
    spans = find_entities(text)
    if not spans:
        return text, 0
    out, at, n = [], 0, 0
    for a, b, kind in spans:
        value = text[a:b]
        new = surrogate(kind, value, key, attempts.get((kind, canonical(kind, value)), 0))
        out += [text[at:a], new]
        n += new != value
        at = b
    return "".join([*out, text[at:]]), n


def entities_of(text: str | None) -> list[tuple[str, str]]:
    """(kind, canonical form) of a text's entities, each once."""
    return list(dict.fromkeys((kind, canonical(kind, text[a:b])) for a, b, kind in find_entities(text)))


def corpus_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value) of canonical forms, each once: what a batch repeats is dropped before the shuffle."""
    tune(docs.sparkSession)
    docs = spread(pick(docs, text=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {e for t in b.column(0).to_pylist() if t for e in entities_of(t)}
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in own], pa.string()) for i in (0, 1)], ["kind", "value"])

    return docs.mapInArrow(run, "kind string, value string").distinct()


def with_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``entities`` (kind, value, attempt) with their surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [whole_surrogate(k, v, key, a) for k, v, a in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "value", "attempt", "surrogate"])

    return entities.select("kind", "value", F.col("attempt").cast("int").alias("attempt")).mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def exceptions(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of entities whose first surrogate is a real entity or another's surrogate."""
    spark = entities.sparkSession
    entities = written(with_surrogates(entities.withColumn("attempt", F.lit(0)), key), "entities")
    real = entities.select("kind", F.col("value").alias("surrogate"))

    def conflicts(new: DataFrame, taken: DataFrame | None) -> DataFrame:
        twice = new.groupBy("kind", "surrogate").agg(F.min("value").alias("keeps"), F.count("*").alias("n")).where("n > 1").drop("n")
        bad = new.join(real, ["kind", "surrogate"], "left_semi").select("kind", "value", "attempt")
        bad = bad.unionByName(new.join(twice, ["kind", "surrogate"]).where("value != keeps").select("kind", "value", "attempt"))
        if taken is not None:
            bad = bad.unionByName(new.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "value", "attempt"))
        return bad.distinct()

    left = written(conflicts(entities, None), "conflicts")
    settled = spark.createDataFrame([], "kind string, value string, attempt int")
    taken = entities.join(left, ["kind", "value"], "left_anti").select("kind", "surrogate")
    turn = 0
    while not left.isEmpty():
        turn += 1
        if turn > FORMAT_ATTEMPTS + WIDTHS * WIDTH_ATTEMPTS:
            raise RuntimeError(f"{left.count()} entities are left without a surrogate of their own")
        new = written(with_surrogates(left.withColumn("attempt", F.lit(turn)), key), "attempts")
        left = written(conflicts(new, taken), "conflicts")
        good = new.join(left, ["kind", "value"], "left_anti")
        settled = settled.unionByName(good.select("kind", "value", "attempt"))
        taken = taken.unionByName(good.select("kind", "surrogate"))
    return written(settled, "exceptions")


def _replace_rows(rows: DataFrame, at: int, key: bytes, attempts: dict | None) -> DataFrame:
    """Rows c0, c1 ... with text ``at`` replaced, and p_entities; without ``attempts`` the last column, own, has the row's."""
    fields = [f for f in rows.schema.fields if f.name != "own"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", p_entities int"
    shared = rows.sparkSession.sparkContext.broadcast(attempts) if attempts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else {}
        for b in batches:
            own = b.column(b.num_columns - 1).to_pylist() if attempts is None else None
            done = [replaced(t, key, known if own is None else {(e["kind"], e["value"]): e["attempt"] for e in own[i] or []}) for i, t in enumerate(b.column(at).to_pylist())]
            columns = list(b.columns[: len(fields)])
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int32())], [*b.schema.names[: len(fields)], "p_entities"])

    return rows.mapInArrow(run, schema)


def _with_own_exceptions(rows: DataFrame, at: int, found: DataFrame) -> DataFrame:
    """Rows with own: the exceptions among the entities of each row's text."""
    rows = written(rows.withColumn("p_row", F.monotonically_increasing_id()), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(i, *e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in entities_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in own], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["p_row", "kind", "value"])

    uses = rows.select("p_row", f"c{at}").mapInArrow(run, "p_row long, kind string, value string")
    own = uses.join(found, ["kind", "value"]).groupBy("p_row").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("own"))
    return rows.join(own, "p_row", "left").drop("p_row")


def replace_entities(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", count_as: str | None = None) -> DataFrame:
    """``docs`` with surrogates in their texts; with ``count_as``, also how many entities each had."""
    names = docs.columns
    at = names.index(text_col) if text_col in names else next(i for i, c in enumerate(names) if c.lower() == text_col.lower())
    tune(docs.sparkSession)
    found = exceptions(corpus_entities(docs, text_col), key)
    rows = spread(docs.toDF(*[f"c{i}" for i in range(len(names))]))
    few = found.limit(BROADCAST_EXCEPTIONS + 1).count() <= BROADCAST_EXCEPTIONS
    if few:
        done = _replace_rows(rows, at, key, {(r["kind"], r["value"]): r["attempt"] for r in found.collect()})
    else:
        done = _replace_rows(_with_own_exceptions(rows, at, found), at, key, None)
    kept = [f"c{i}" for i in range(len(names))]
    return done.select(*kept, "p_entities").toDF(*names, count_as) if count_as else done.select(*kept).toDF(*names)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its entities."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return replace_entities(docs, count_as="n_entities")
