import hashlib
import random
import zlib

import numpy as np
import pytest

from tallymart.llm import jpeg
from tallymart.llm.common import table


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 384, 385, 5000, 40000])
def test_round_trip_and_both_readers(size):
    payload = jpeg.pad(random.Random(size).randbytes(size))
    assert len(payload) % 64 == 0 and len(payload) >= 64
    raw = jpeg.write(payload)
    fast, slow = jpeg.read_coefficients(raw), jpeg.read_coefficients(raw, general=True)
    assert fast.fast_scans == 12 and slow.fast_scans == 0
    for c in fast.coefs:
        assert np.array_equal(fast.coefs[c], slow.coefs[c])
    assert jpeg.unplace(list(slow.coefs.values()), len(payload)) == payload
    assert raw == jpeg.write(payload)


def test_all_byte_values_and_stuffing():
    payload = bytes(range(256)) * 3 + b"\xff" * 128 + b"\x00" * 128
    assert jpeg.unplace(list(jpeg.read_coefficients(jpeg.write(payload)).coefs.values()), len(payload)) == payload


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]


def grey_file(scans, restart=0):
    """A one-component 16 x 8 file (two blocks) from scans of (header, dc lengths/symbols or ac, bits per interval)."""
    import struct

    out = [b"\xff\xd8", jpeg.segment(0xDB, b"\0" + bytes([2] * 64)), jpeg.segment(0xC2, struct.pack(">BHHB", 8, 8, 16, 1) + bytes([1, 0x11, 0]))]
    if restart:
        out.append(jpeg.segment(0xDD, struct.pack(">H", restart)))
    for kind, lengths, symbols, spec, intervals in scans:
        out.append(jpeg.huffman_segment(kind, 0, lengths + [0] * (16 - len(lengths)), bytes(symbols)))
        out.append(jpeg.segment(0xDA, bytes([1, 1, 0, *spec])))
        for k, bits in enumerate(intervals):
            out.append((bytes([0xFF, 0xD0 + k - 1]) if k else b"") + jpeg.pack_bits(np.array(bits, np.uint8)))
    return b"".join([*out, b"\xff\xd9"])


def test_runs_end_of_band_runs_refinement_and_restarts():
    dc = Out()
    dc.put(0b01, 2)  # category 2
    dc.put(0b11, 2)  # +3
    dc2 = Out()
    dc2.put(0b00, 2)  # category 1
    dc2.put(0, 1)  # -1; the difference starts anew after a restart
    ac = Out()  # symbols: 0x11 -> 00, 0xF0 -> 01, 0x01 -> 10, 0x10 (end of band, 2 to 3 blocks) -> 110
    ac.put(0b00, 2), ac.put(1, 1)  # one zero, then +1 at k = 2
    ac.put(0b01, 2), ac.put(0b10, 2), ac.put(0, 1)  # sixteen zeros, then -1 at k = 19
    ac.put(0b110, 3), ac.put(0, 1)  # end of band for this block and the next
    fine = Out()  # symbols: 0x21 -> 0, 0x00 -> 10
    fine.put(0b0, 1), fine.put(1, 1)  # two zeros, then a fresh +1: passes k = 1, corrects k = 2, zero k = 3, new at 4
    fine.put(1, 1)  # correction of k = 2
    fine.put(0b10, 2), fine.put(0, 1)  # end of band; correction of k = 19: none
    fine.put(0b10, 2)  # nothing in the second block
    scans = [
        (0, [0, 2], [1, 2], (0, 0, 0x00), [dc.bits, dc2.bits]),
        (1, [0, 3, 1], [0x11, 0xF0, 0x01, 0x10], (1, 63, 0x01), [ac.bits + [0] * 0, []]),
    ]
    file = jpeg.read_coefficients(grey_file(scans[:1], restart=1))
    assert file.coefs[1][0, 0, 0] == 3 and file.coefs[1][0, 1, 0] == -1
    scans = [(1, [0, 3, 1], [0x11, 0xF0, 0x01, 0x10], (1, 63, 0x01), [ac.bits]), (1, [1, 1], [0x21, 0x00], (1, 63, 0x10), [fine.bits])]
    file = jpeg.read_coefficients(grey_file(scans))
    block = file.coefs[1][0, 0]
    assert {k: int(block[k]) for k in np.flatnonzero(block)} == {2: 3, 4: 1, 19: -2}
    assert not file.coefs[1][0, 1].any()
    assert jpeg.rgb(file).shape == (8, 16, 3)


def test_inverse_transform_and_chroma():
    file = jpeg.read_coefficients(jpeg.write(bytes(64)))
    for c in file.coefs.values():
        c[:] = 0
    file.coefs[1][0, 0, 0] = 80  # 10 above mid-grey in the first luma block
    file.coefs[3][0, 0, 0] = 8 * 50
    r = jpeg.rgb(file)
    assert r.shape == (16, 16, 3) and r[0, 0].tolist() == [208, 102, 138] and r[15, 15].tolist() == [198, 92, 128]
    block = np.zeros(64, np.float32)
    block[jpeg.ZIGZAG[5]] = 100
    file.coefs[1][:] = 0
    file.coefs[3][:] = 0
    file.coefs[1][0, 0, 5] = 100
    u, v = divmod(int(jpeg.ZIGZAG[5]), 8)
    c = lambda k: np.sqrt(1 / 8) if k == 0 else 0.5
    want = [[128 + 100 * c(u) * c(v) * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for x in range(8)] for y in range(8)]
    assert np.abs(jpeg.planes(file)[0][:8, :8] - np.array(want)).max() <= 0.51


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="progressive"):
        jpeg.read_coefficients(b"\xff\xd8" + jpeg.segment(0xC0, bytes(15)) + b"\xff\xd9")


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = jpeg.op6_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        media = jpeg.write(payload)
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.feature == jpeg.feature(jpeg.rgb(jpeg.read_coefficients(media)))


def test_nulls_repeats_tensors_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "", 4), (None, "x" * 700, None)], "doc_id long, text string, width_hint int")
    rows = jpeg.load(jpeg.store(docs)).withColumn("payload", jpeg.cut_payload()).collect()
    assert len(rows) == 4
    assert {(r.n_bytes, len(r.payload)) for r in rows} == {(0, 64), (700, 704)}
    assert all(len(r.tensor) == r.height * r.width * 3 for r in rows)
    assert jpeg.store(docs.limit(0)).count() == 0
    taken = jpeg.store(docs.withColumnRenamed("width_hint", "media"))  # the new column gives way
    assert taken.columns == ["doc_id", "text", "media", "n_bytes", "media_"]
    assert sorted((r.media, r.media_ is not None) for r in taken.collect() if r.media) == [(3, True), (4, True), (4, True)]
