import random
import zlib

import pytest
from pyspark.sql import functions as F

from deltaloom.codec import patch, rangecoder
from deltaloom.functions import bits


def one(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()]


NUMBERS = [0, 1, 2, 63, 64, 127, 128, 255, 300, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, (1 << 32) - 1]


def test_variable_length_integers(spark):
    rows = one(spark, [(v,) for v in NUMBERS], "v long", v=F.col("v"), n=bits.uleb_length("v"), b=bits.uleb_bytes("v"), o=bits.uleb_bytes("v", True), back=bits.uleb_value(bits.uleb_bytes("v")), again=bits.uleb_value(bits.uleb_bytes("v", True)))
    for v, n, b, o, back, again in rows:
        assert bytes(b) == rangecoder.uleb(v) and bytes(o) == rangecoder.uleb(v, True)
        assert n == len(b) and back == v
        assert again == (v if len(o) <= 5 else None)


def test_zigzag_and_wrap(spark):
    values = [0, 1, -1, 5, -5, (1 << 31) - 1, -(1 << 31)]
    for v, z, back, u, i in one(spark, [(v,) for v in values], "v long", v=F.col("v"), z=bits.zigzag("v"), b=bits.unzigzag(bits.zigzag("v")), u=bits.u32("v"), i=bits.i32(F.col("v") + (1 << 32))):
        assert z == rangecoder.zigzag(v) and back == v and u == v % (1 << 32) and i == v
    rows = one(spark, [(10, 3), (10, 21), (10, 8)], "b long, z long", x=bits.zigzag_absolute("b", "z", 12))
    assert rows == [(8,), (None,), (None,)]
    assert one(spark, [(2147483647, 1)], "a int, b int", x=bits.add_checked("a", "b"), y=bits.subtract_checked("a", "b")) == [(None, 2147483646)]


def test_code_lengths(spark):
    for v, b, g, d in one(spark, [(v,) for v in NUMBERS], "v long", v=F.col("v"), b=bits.bit_length("v"), g=bits.gamma_length(F.col("v") + 1), d=bits.delta_length("v")):
        n = (v + 1).bit_length()
        assert b == max(1, v.bit_length()) and g == 2 * n - 1 and d == 2 * n.bit_length() - 1 + n - 1


def test_branches(spark):
    rng = random.Random(1)
    words = [(0xF000 | rng.randrange(2048), 0xD000 | rng.randrange(0x2FFF) & 0x2FFF, rng.randrange(1 << 20) * 2, rng.randrange(-5000, 5000)) for _ in range(300)]
    up, low = F.col("u"), F.col("l")
    rows = one(spark, words, "u long, l long, pc long, d long", u=up, l=low, pc=F.col("pc"), d=F.col("d"), like=bits.is_branch(up, low), imm=bits.branch_imm24(up, low), goal=bits.branch_target(F.col("pc"), up, low), pu=bits.branch_pack_up(bits.branch_imm24(up, low)), pl=bits.branch_pack_low(bits.branch_imm24(up, low)), m=bits.branch_moved(up, low, F.col("d")))
    for u, lo, pc, d, like, imm, goal, pu, pl, m in rows:
        w = u | lo << 16
        assert like == patch.branch_like(w)
        assert imm == patch.branch_imm(w) and goal == patch.branch_goal(pc, w) and (pu, pl) == (u, lo)
        assert m == (imm - d) % (1 << 24) and patch.branch_word(imm) == w


def test_hazards_and_pages(spark):
    rows = one(spark, [(0, 600, 1000, 1000, True), (300, 600, 1000, 1000, True), (600, 0, 1000, 1000, False), (300, 0, 1000, 1000, False), (-5, 600, 1000, 1000, True)], "a long, t long, f long, s long, w boolean", x=bits.copy_hazard(F.col("a"), F.col("t"), F.col("f"), F.col("s"), F.col("w")))
    assert [r[0] for r in rows] == [True, False, True, False, False]
    assert one(spark, [(0,), (255,), (256,), (513,)], "p long", b=bits.page_base("p"), s=bits.page_slot("p"), r=bits.page_round_up("p")) == [(0, 0, 0), (0, 0, 256), (256, 1, 256), (512, 0, 768)]


def test_probabilities(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(b + 1), b) for b in [*range(1, 60), 1 << 26] for _ in range(3)] + [(0, 0)]
    for n, d, p in one(spark, rows, "n long, d long", n=F.col("n"), d=F.col("d"), p=bits.ratio_prob("n", "d")):
        assert p == (2048 if d == 0 else max(1, min(4095, (8192 * n + d) // (2 * d))))
    rows = [(p, b) for p in range(1, 4096, 7) for b in (0, 1)]
    for p, b, price, step in one(spark, rows, "p int, b int", p=F.col("p"), b=F.col("b"), x=bits.bit_price("p", F.col("b")), s=bits.prob_step(F.col("p"), F.col("b"))):
        assert price == rangecoder.bit_price(p, b) and step == (p - (p >> 4) if b else p + (4096 - p >> 4))


def test_bytes_and_contexts(spark):
    data = bytes(range(256)) * 2
    rows = one(spark, [(data, i) for i in (-1, 0, 5, 255, 511, 512)], "b binary, i int", v=bits.byte_at(F.col("b"), F.col("i")), c=bits.wire_crc(F.col("b")))
    assert [r[0] for r in rows] == [0, 0, 5, 255, 255, 0] and rows[0][1] == zlib.crc32(data) ^ 1
    assert [r[0] for r in one(spark, [(i,) for i in range(256)], "i int", c=bits.literal_class(F.col("i")))] == patch.CLASSES


@pytest.mark.parametrize("forward", [True, False])
def test_out_match_chain(spark, forward):
    rows = one(spark, [(100, 90, 7)], "p long, e long, n long", d=bits.out_match_delta(F.col("p"), F.col("e")), back=bits.out_match_position(F.col("e"), bits.out_match_delta(F.col("p"), F.col("e"))), x=bits.out_match_next(F.col("p"), F.col("n"), F.lit(forward)))
    assert rows == [(10, 100, 107 if forward else 93)]
