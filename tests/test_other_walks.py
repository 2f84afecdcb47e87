import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.sources import records as rec

HEADS = {"class": b"\xca\xfe\xba\xbe\0\0\0\x34\0\x02\x01\0\x01A", "rpm": b"\xed\xab\xee\xdb\3" + bytes(91) + b"\x8e\xad\xe8\1" + bytes(4) + b"\0\0\0\1\0\0\0\4", "assembly": b"MZ" + bytes(58) + b"\x40\0\0\0PE\0\0"}


def test_kinds():
    assert set(rec.OTHER_WALKS) == set(HEADS) and not set(rec.OTHER_WALKS) & set(rec.WALKS)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(HEADS)), st.binary(max_size=60), st.integers(0, 120))
def test_damage_ends_a_walk(kind, noise, at):
    whole = HEADS[kind] + bytes(120)
    try:
        assert sum(1 for _ in rec.OTHER_WALKS[kind](whole[:at] + noise + whole[at + len(noise) :])) < 5_000
    except (ValueError, KeyError, IndexError, struct.error):
        pass


@pytest.mark.parametrize("kind", sorted(HEADS))
def test_empty_table(spark, kind):
    assert rec.records(spark.createDataFrame([], "id string, content binary"), kind).count() == 0
