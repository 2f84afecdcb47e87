import numpy as np
import pytest

from ledgerloom.llm import media
from ledgerloom.llm.media import aligned, chroma, fingerprint, match, op3_chroma_fingerprints, samples_of, wave


def melody(seed, notes=60, rate=8000):
    rng = np.random.default_rng(seed)
    t = np.arange(800) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, notes)]).astype(np.float32) * 0.5


def test_wave_round_trip():
    x = melody(1, 3)
    y, rate = samples_of(wave(x, 11025))
    assert rate == 11025 and np.allclose(x, y, atol=1e-4)
    for bad in (None, b"", b"RIFF", b"x" * 100, wave(x, 8000)[:50]):
        assert len(fingerprint(chroma(*samples_of(bad)))) == 0


def test_integral_sums_like_plain_sums():
    rng = np.random.default_rng(2)
    picture = rng.random((40, 12)).astype(np.float32)
    got = fingerprint(picture)
    for n in (0, 7, 24):
        packed = 0
        for kind, y, h, w in media.FILTERS:
            part = picture[n : n + w].astype(float)
            box, mx, my = part[:, y : y + h], w // 2, h // 2
            one = {0: box, 1: box[:, my:], 2: box[mx:]}.get(kind)
            one = one.sum() if kind < 3 else box[:mx, :my].sum() + box[mx:, my:].sum()
            other = (part.sum() if kind == 0 else box.sum()) - one
            level = int(np.digitize(np.log((1 + one) / (1 + other)), media.LEVELS))
            packed = packed << 2 | (level ^ level >> 1)
        assert packed == got[n]


def test_alignment():
    x, rng = melody(3), np.random.default_rng(0)
    noisy = x[media.HOP * 20 :] + rng.normal(size=len(x) - media.HOP * 20).astype(np.float32) * 0.02
    a, b, c = (fingerprint(chroma(s, 8000)) for s in (x, noisy, melody(4)))
    offset, size, error = aligned(a, b)
    assert offset == 20 and size == len(b) and error < 0.1
    assert aligned(a, c)[2] > 0.2


def test_match(spark):
    x = melody(5)
    rows = [(1, wave(x, 8000)), (2, wave(x * 0.5, 8000)), (3, wave(x[media.HOP * 15 :], 8000)), (4, wave(melody(6), 8000)), (5, None), (6, b"junk"), (7, wave(x * 0, 8000)), (8, wave(x, 8000)), (8, wave(x, 8000)), (None, None)]
    df = spark.createDataFrame([(*r, "u") for r in rows], "id long, audio binary, same string")
    got = {r.id: r for r in match(df).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 8)] == [1] * 4 and got[8].class_id == 1
    assert [got[i].component_id for i in (4, 5, 6, 7)] == [4, 5, 6, 7] and got[4].n_links == 0
    assert match(df).count() == len(rows) and match(df.limit(0)).count() == 0


def test_whole_table(spark):
    rows = op3_chroma_fingerprints(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert all(r.component_id <= r.class_id <= r.vec_id for r in rows)


def test_keys():
    assert media.keys(np.zeros(0, np.uint32)).tolist() == [] and media.keys(np.array([5], np.uint32)).tolist() == [5 << 32 | 5]
    assert media.keys(np.array([1, 2, 3, 1, 2, 3], np.uint32)).tolist() == sorted({1 << 32 | 3, 2 << 32 | 1, 3 << 32 | 2})


def test_all_links_count(spark):
    """n_links and components against all pairs, for copies that match each other but not all the same first one."""
    rng, rows = np.random.default_rng(9), []
    for i in range(36):
        x = melody(20 + i % 4)[media.HOP * int(rng.integers(0, 40)) :]
        rows.append((i, wave(x + rng.normal(size=len(x)).astype(np.float32) * (0.01, 0.05, 0.15)[i % 3], 8000)))
    prints = [fingerprint(chroma(*samples_of(w))) for _, w in rows]
    links = [(a, b) for a in range(36) for b in range(a) if (got := aligned(prints[a], prints[b]))[1] and got[2] <= 0.12]
    want = [sum(i in link for link in links) for i in range(36)]
    got = {r.id: r for r in match(spark.createDataFrame(rows, "id long, audio binary")).collect()}
    assert max(want) > 2 and [got[i].n_links for i in range(36)] == want
    assert all(got[a].component_id == got[b].component_id for a, b in links)


def test_single_shared_integers_are_compared():
    """Recordings with one equal integer and small errors elsewhere are candidates and match."""
    a = np.random.default_rng(1).integers(0, 2**32, 60).astype(np.uint32)
    b = a ^ np.uint32(1)
    b[30] ^= 1
    assert media.sharing([a], [b, a + np.uint32(2)]).tolist()[0] == [0, 0] and aligned(a, b)[:2] == (0, 60)


def test_steady_sounds_count_whole():
    steady, rng = np.full(300, 7, np.uint32), np.random.default_rng(2)
    a = np.concatenate([rng.integers(0, 2**32, 100).astype(np.uint32), steady])
    b = np.concatenate([a[90:100], steady])
    assert aligned(a, b)[:2] == (90, 310)


def links_at_any_offset(prints, least=8, error=0.12):
    """All pairs of fingerprints that differ in few enough bits at some offset, shared integers or not."""
    found = set()
    for j, b in enumerate(prints):
        for i, a in enumerate(prints[:j]):
            for offset in range(least - len(b), len(a) - least + 1):
                x, y = a[max(0, offset) :], b[max(0, -offset) :]
                n = min(len(x), len(y))
                if np.bitwise_count(x[:n] ^ y[:n]).sum() <= error * 32 * n:
                    found.add((i, j))
                    break
    return found


@pytest.mark.parametrize("n", [30, 90])
def test_recall_against_all_pairs_and_offsets(n):
    """Shifted, cut and noisy recordings of shared melodies."""
    rng, prints = np.random.default_rng(n), []
    for i in range(n):
        x = melody(100 + i % (n // 6), 24)[media.HOP * int(rng.integers(0, 25)) :]
        x = x[: len(x) - media.HOP * int(rng.integers(0, 10))]
        prints.append(fingerprint(chroma(x + rng.normal(size=len(x)).astype(np.float32) * (0.0, 0.02, 0.06, 0.1, 0.2, 0.3)[i * 7 % 6], 8000)))
    want = links_at_any_offset(prints)
    own = media.Prints(prints)
    got = {(i, j) for i, j in media.near(own, own, 8, 0.12, True).tolist() if media.is_match(prints[i], prints[j], 8, 0.12)}
    assert len(want) >= n / 2 and got <= want and len(got & want) >= 0.9 * len(want)


def test_recall_on_the_table(spark):
    """All pairs of 120 melodies, 40 of which come again, cut and noisy."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(120)
    sounds = [samples_of(r.audio)[0] for r in media.sonified(vectors, "vec_id", "embedding").collect()]
    rng = np.random.default_rng(1)
    sounds += [x[media.HOP * 9 :] + rng.normal(size=len(x) - media.HOP * 9).astype(np.float32) * 0.05 for x in sounds[:40]]
    prints = [fingerprint(chroma(x, 8000)) for x in sounds]
    want, own = links_at_any_offset(prints), media.Prints(prints)
    got = {(i, j) for i, j in media.near(own, own, 8, 0.12, True).tolist() if media.is_match(prints[i], prints[j], 8, 0.12)}
    assert len(want) >= 30 and got <= want and len(got & want) >= 0.9 * len(want)
