"""Integer and wire arithmetic as column expressions.

Unsigned 32-bit values are LONG columns from 0 to 2^32-1; nothing here may overflow, as ANSI
mode would raise. Every function takes and returns columns and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 1 << 32
#: Fixed values of the patch format.
WIRE_VERSION = 1
MAX_IMAGE = 64 << 20
PAGE = 256
PAGE_DEPTH = 2
WINDOW = 2048
PRICE_SCALE = 64
RICE_UNARY_MAX = 1 << 20


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def long(x: Column | str | int) -> Column:
    return _c(x).cast("long")


def u32(x: Column | str) -> Column:
    """The value modulo 2^32."""
    return F.pmod(long(x), F.lit(U32))


def i32(x: Column | str) -> Column:
    """The signed value of the low 32 bits."""
    u = u32(x)
    return F.when(u > 2147483647, u - U32).otherwise(u)


def add_checked(a: Column | str, b: Column | str) -> Column:
    """a + b, null where a 32-bit sum would overflow."""
    return F.try_add(_c(a).cast("int"), _c(b).cast("int"))


def subtract_checked(a: Column | str, b: Column | str) -> Column:
    return F.try_subtract(_c(a).cast("int"), _c(b).cast("int"))


def u16le(b0: Column, b1: Column) -> Column:
    return long(b0) + 256 * long(b1)


def u32le(b0: Column, b1: Column, b2: Column, b3: Column) -> Column:
    return long(b0) + 256 * long(b1) + 65536 * long(b2) + 16777216 * long(b3)


def u32le_bytes(x: Column | str) -> Column:
    """The four bytes, least first, as an array."""
    u = u32(x)
    return F.array(*[F.shiftright(u, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(4)])


def zigzag(v: Column | str) -> Column:
    v = long(v)
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(u: Column | str) -> Column:
    u = long(u)
    return F.shiftright(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def zigzag_absolute(base: Column | str, z: Column | str, most: int = MAX_IMAGE) -> Column:
    """base plus the zigzag-coded difference, null outside 0..most."""
    found = long(base) + unzigzag(z)
    return F.when((found >= 0) & ((long(z) % 2 == 1) | (found <= most)), found)


def uleb_length(v: Column | str) -> Column:
    v = long(v)
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5)


def uleb_bytes(v: Column | str, overlong: bool = False) -> Column:
    """The bytes of a variable-length integer as an array; overlong adds a redundant zero byte."""
    v = long(v)
    n = uleb_length(v)
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftright", v, (7 * i).cast("int")).bitwiseAND(F.lit(127).cast("long")))
    last = F.lit(-1) if overlong else n - 1
    out = F.transform(digits, lambda d, i: F.when(i == last, d).otherwise(d + 128).cast("int"))
    return F.concat(out, F.array(F.lit(0))) if overlong else out


def uleb_value(b: Column) -> Column:
    """The value of an array of bytes, null where it exceeds 32 bits or the bytes don't end there."""
    folded = F.aggregate(b, F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("n")), lambda s, x: F.struct((s["v"] + x.bitwiseAND(F.lit(127)).cast("long") * F.pow(F.lit(128.0), s["n"]).cast("long")).alias("v"), (s["n"] + 1).alias("n")))
    ends = F.forall(F.transform(b, lambda x, i: (x >= 128) == (i < F.size(b) - 1)), lambda ok: ok)
    return F.when((F.size(b) > 0) & (F.size(b) <= 5) & ends & (folded["v"] < U32), folded["v"])


def uleb_overlong(n: Column, last: Column) -> Column:
    return (n > 1) & (last == 0)


def bit_length(v: Column | str) -> Column:
    """Bits of v, 1 for 0."""
    return F.length(F.bin(long(v)))


def gamma_length(v: Column | str) -> Column:
    """Bits of an Elias-gamma code of v >= 1."""
    return 2 * bit_length(v) - 1


def delta_length(v: Column | str) -> Column:
    """Bits of an Elias-delta code of v + 1: that of its length by gamma, and all but the first of its own."""
    n = bit_length(long(v) + 1)
    return gamma_length(n) + n - 1


def rice_feasible(v: Column | str, k: Column | str | int) -> Column:
    return F.call_function("shiftright", long(v), _c(k).cast("int")) <= RICE_UNARY_MAX


def rice_length(v: Column | str, k: Column | str | int) -> Column:
    return F.call_function("shiftright", long(v), _c(k).cast("int")) + 1 + _c(k)


def page_number(pos: Column | str) -> Column:
    return F.floor(long(pos) / PAGE).cast("long")


def page_base(pos: Column | str) -> Column:
    return page_number(pos) * PAGE


def page_slot(pos: Column | str) -> Column:
    return F.pmod(page_number(pos), F.lit(PAGE_DEPTH))


def page_round_up(size: Column | str) -> Column:
    return page_number(long(size) + PAGE - 1) * PAGE


def wire_crc(image: Column) -> Column:
    """The source checksum with the format's revision folded in."""
    return F.crc32(image).bitwiseXOR(F.lit(WIRE_VERSION).cast("long"))


def byte_at(image: Column, pos: Column) -> Column:
    """The byte at pos (from 0), 0 outside the image."""
    one = F.substring(image, (pos + 1).cast("int"), F.lit(1))
    inside = (pos >= 0) & (pos < F.octet_length(image))
    return F.when(inside, F.conv(F.hex(one), 16, 10).cast("int")).otherwise(0)


def diff_byte(to: Column, source: Column) -> Column:
    """What a copy of ``source`` needs to give ``to``, modulo 256; a missing source byte is 0."""
    return F.pmod(to - F.coalesce(source, F.lit(0)), F.lit(256))


def is_branch(up: Column, low: Column) -> Column:
    """Two halfwords that look like a Thumb branch with link."""
    return (up.bitwiseAND(F.lit(0xF800)) == 0xF000) & (low.bitwiseAND(F.lit(0xD000)) == 0xD000)


def branch_imm24(up: Column, low: Column) -> Column:
    """The raw 24-bit immediate, in halfwords."""
    up, low = long(up), long(low)
    s = F.shiftright(up, 10).bitwiseAND(F.lit(1).cast("long"))
    i1 = 1 - F.shiftright(low, 13).bitwiseAND(F.lit(1).cast("long")).bitwiseXOR(s)
    i2 = 1 - F.shiftright(low, 11).bitwiseAND(F.lit(1).cast("long")).bitwiseXOR(s)
    return up.bitwiseAND(F.lit(0x3FF).cast("long")) * 2048 + low.bitwiseAND(F.lit(0x7FF).cast("long")) + s * (1 << 23) + i1 * (1 << 22) + i2 * (1 << 21)


def branch_signed(up: Column, low: Column) -> Column:
    imm = branch_imm24(up, low)
    return F.when(imm >= 1 << 23, imm - (1 << 24)).otherwise(imm)


def branch_pack_up(imm: Column | str) -> Column:
    imm = long(imm)
    s = F.shiftright(imm, 23).bitwiseAND(F.lit(1).cast("long"))
    return 0xF000 + s * 1024 + F.shiftright(imm, 11).bitwiseAND(F.lit(0x3FF).cast("long"))


def branch_pack_low(imm: Column | str) -> Column:
    imm = long(imm)
    s = F.shiftright(imm, 23).bitwiseAND(F.lit(1).cast("long"))
    j1 = 1 - F.shiftright(imm, 22).bitwiseAND(F.lit(1).cast("long")).bitwiseXOR(s)
    j2 = 1 - F.shiftright(imm, 21).bitwiseAND(F.lit(1).cast("long")).bitwiseXOR(s)
    return 0xD000 + j1 * 8192 + j2 * 2048 + imm.bitwiseAND(F.lit(0x7FF).cast("long"))


def branch_target(pc: Column | str, up: Column, low: Column) -> Column:
    return u32(long(pc) + 4 + 2 * branch_signed(up, low))


def branch_moved(up: Column, low: Column, delta: Column) -> Column:
    """The immediate less a relocation delta, modulo 2^24."""
    return F.pmod(branch_imm24(up, low) - long(delta), F.lit(1 << 24))


def is_literal_load(up: Column) -> Column:
    """A halfword that looks like a Thumb load from its literal pool."""
    return up.bitwiseAND(F.lit(0xF800)) == 0x4800


def literal_target(address: Column | str, up: Column) -> Column:
    return u32((F.floor(long(address) / 4) + up.bitwiseAND(F.lit(0xFF)).cast("long") + 1) * 4)


def target_in_op(fp0: Column, diff_len: Column, target: Column) -> Column:
    """Whether an aligned word at ``target`` lies below the end of an op's copy."""
    end = long(fp0) + long(diff_len)
    return (target % 4 == 0) & (diff_len >= 0) & (end <= 2147483647) & (end >= 4) & (target <= end - 4)


def first_scanned(fp0: Column, target: Column) -> Column:
    """The lowest even address whose load can reach ``target`` within an op."""
    low = F.greatest(long(target) - 1024, long(fp0), F.lit(0).cast("long"))
    return low + low % 2


def covered(source: Column, out: Column, forward: Column) -> Column:
    """Whether a source byte's page is still uncommitted while ``out`` is written."""
    a, t = page_number(source), page_number(out)
    return F.when(forward, a >= t - (PAGE_DEPTH - 1)).otherwise(a <= t + (PAGE_DEPTH - 1))


def copy_hazard(source: Column, out: Column, from_size: Column, to_size: Column, forward: Column) -> Column:
    """A copy whose source was overwritten: inside both images, behind the frontier and committed."""
    behind = F.when(forward, source < out).otherwise(source > out)
    return (source >= 0) & (source < from_size) & (source < to_size) & behind & ~covered(source, out, forward)


def natural_descending(from_size: Column, to_size: Column) -> Column:
    """An image that grows is written from its end."""
    return to_size > from_size


def is_natural(from_size: Column, to_size: Column, descending: Column) -> Column:
    return natural_descending(from_size, to_size) == descending


def out_match_delta(position: Column, expected: Column) -> Column:
    return i32(long(position) - long(expected))


def out_match_position(expected: Column, delta: Column) -> Column:
    return u32(long(expected) + long(delta))


def out_match_next(position: Column, length: Column, forward: Column) -> Column:
    return u32(F.when(forward, long(position) + long(length)).otherwise(long(position) - long(length)))


def prob_step(p: Column, bit: Column, rate: int = 4, whole: int = 4096) -> Column:
    """A probability of zero after a bit: nudged by 1/2^rate; ``whole`` is 4096, or 256 in byte trees."""
    return F.when(bit == 1, p - F.shiftright(p, rate)).otherwise(p + F.shiftright(F.lit(whole) - p, rate)).cast("int")


def ratio_prob(num: Column, den: Column) -> Column:
    """num / den as a 12-bit probability, rounded half up, within 1..4095; 2048 for nothing."""
    num, den = long(num), long(den)
    p = F.floor((8192 * num + den) / F.when(den > 0, 2 * den)).cast("long")
    return F.when(den == 0, F.lit(2048)).otherwise(F.greatest(F.lit(1), F.least(F.lit(4095), p)))


def tree_prob(p12: Column) -> Column:
    """A 12-bit probability in a byte tree's 8 bits, within 1..255."""
    return F.greatest(F.lit(1), F.least(F.lit(255), F.shiftright(p12 + 8, 4)))


#: 2^16 * log2(1 + i / 32) for i = 0..32.
LOG2_POINTS = (
    0, 2909, 5732, 8473, 11136, 13727, 16248, 18704, 21098, 23433, 25711, 27936, 30109, 32234, 34312, 36346, 38336,
    40286, 42196, 44068, 45904, 47705, 49472, 51207, 52911, 54584, 56229, 57845, 59434, 60997, 62534, 64047, 65535,
)


def bit_price(p: Column | str, bit: Column | int) -> Column:
    """The cost of a bit whose probability of zero is p / 4096, in 1/64 bits, by interpolated logarithms."""
    chance = F.greatest(F.lit(1).cast("long"), F.when(_c(bit) == 1, 4096 - long(p)).otherwise(long(p)))
    e = bit_length(chance) - 1
    fraction = F.floor(chance * F.pow(F.lit(2.0), 16 - e)).cast("long") - 65536
    i, rest = F.floor(fraction / 2048).cast("int"), fraction % 2048
    points = F.array(*[F.lit(x).cast("long") for x in LOG2_POINTS])
    low, high = F.element_at(points, i + 1), F.element_at(points, i + 2)
    log = low + F.floor((high - low) * rest / 2048).cast("long")
    return ((12 - e) * PRICE_SCALE - F.floor(log * PRICE_SCALE / 65536)).cast("long")


def literal_classes() -> list[int]:
    """The literal model of each preceding byte, 256 entries from the format's 128 packed pairs."""
    return [(LITERAL_PAIRS[b >> 1] >> (4 * (b & 1))) & 15 for b in range(256)]


#: Model numbers of bytes 2i (low four bits) and 2i+1 (high four bits).
LITERAL_PAIRS = (
    5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 49, 1,
    34, 34, 34, 34, 34, 34, 34, 34, 17, 17, 17, 17, 17, 17, 17, 1,
    19, 51, 51, 19, 17, 17, 17, 17, 1, 17, 19, 19, 48, 16, 0, 16,
    51, 51, 51, 51, 51, 3, 51, 51, 51, 51, 51, 51, 51, 51, 51, 3,
    51, 51, 17, 3, 51, 19, 51, 19, 34, 34, 34, 34, 34, 34, 34, 34,
    0, 2, 48, 0, 34, 34, 18, 18, 0, 0, 16, 16, 1, 17, 17, 1,
    2, 17, 1, 32, 1, 32, 33, 2, 17, 17, 17, 32, 17, 17, 17, 0,
    1, 0, 0, 0, 0, 0, 0, 0, 5, 0, 0, 64, 0, 0, 0, 0,
)


def literal_class(previous: Column) -> Column:
    """The literal model chosen by the preceding byte."""
    return F.element_at(F.array(*[F.lit(x) for x in literal_classes()]), previous.cast("int") + 1)


def flag_history(history: Column, bit: Column) -> Column:
    return (2 * history + bit) % 4


def repeat_context(repeated: Column, last: Column) -> Column:
    return repeated + F.when(last == 0, 2).otherwise(0)


def trigram_key(b0: Column, b1: Column, b2: Column) -> Column:
    return long(b0) + 256 * long(b1) + 65536 * long(b2)


def candidate_value(length: Column, distance: Column) -> Column:
    """Worth of a match: its length against the bits of its distance."""
    return 16 * length - (bit_length(distance) - 1)


def predicted_branch(shift_pc: Column, shift_target: Column) -> Column:
    """Half the difference of two shifts, truncated toward zero."""
    d = i32(long(shift_pc) - long(shift_target))
    return F.when(d < 0, -F.floor(-d / 2)).otherwise(F.floor(d / 2)).cast("long")


def predicted_word(shift_word: Column) -> Column:
    return i32(-long(shift_word))


def residual(need: Column, predicted: Column) -> Column:
    return i32(long(need) - long(predicted))
