"""Operator 6: media columns as progressive JPEG.

Bytes are stored losslessly as quantised DCT coefficients (the unit of the format, with quantisers of 1): 64 bytes
fill a block, byte b being the coefficient of magnitude category 8 whose extra bits are b. Blocks fill a 4:2:0 colour
image, which is written in seven scans: DC without its low bit, two AC bands without theirs, and a refinement of each.
Reading accumulates the scans (spectral selection and successive approximation) into coefficient arrays; the image
itself comes from an inverse transform, chroma upsampling and conversion to RGB, all in numpy.

``read_coefficients`` reads any 8-bit progressive Huffman JPEG with one scan table set per scan. Where all symbols of
an AC scan are one and the same code, which is so in what ``write`` makes, a scan is read as an array of fixed-width
fields; the check is made on the bits themselves, and other scans take the general path, symbol by symbol.

Defined results: a null text is stored as an empty one; a payload has at least 64 bytes; texts are stored whole; equal
texts give equal files, tensors and features; repeated rows are stored each; an empty table gives none; the
input's columns pass through unchanged, and a new column whose name is taken comes under the first free one of name_,
name__ and so on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import free_name, one_blas_thread, plain_names, position, table

#: Fixed by the JPEG standard: the zigzag order of coefficients in a block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))

BANDS = ((1, 5), (6, 63))
#: Components: id, horizontal and vertical sampling. Six blocks in a unit of 16 x 16 pixels.
SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
PER_UNIT = 6
#: Units in a row of the image, and how many rows of 16 pixels the format can hold; wider only beyond that.
WIDTH_UNITS, MOST_UNITS = 64, 4095


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


# ---------------------------------------------------------------- layout of blocks


def geometry(blocks: int) -> tuple[int, int]:
    """Units across and down that hold so many blocks."""
    units = -(-blocks // PER_UNIT)
    across = min(units, max(WIDTH_UNITS, -(-units // MOST_UNITS)))
    return across, -(-units // across)


def place(payload: bytes) -> tuple[list[np.ndarray], int, int]:
    """Coefficients (rows, columns, 64 in zigzag order) of the three components, and the units across and down.

    Unit u of the image holds blocks 6u to 6u + 5 of the payload: four of luma, one of each chroma. Blocks past the
    payload are of bytes 0.
    """
    across, down = geometry(len(payload) // 64)
    data = np.zeros((across * down * PER_UNIT, 64), np.uint8)
    data[: len(payload) // 64] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    value = data.astype(np.int16)
    value[data < 128] -= 255  # category 8: 128..255 as they are, -255..-128 for 0..127
    unit = value.reshape(down, across, PER_UNIT, 64)
    luma = unit[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * down, 2 * across, 64)
    return [luma, unit[:, :, 4], unit[:, :, 5]], across, down


def unplace(coefs: list[np.ndarray], size: int) -> bytes:
    """The payload of ``size`` bytes back from coefficients."""
    down, across = coefs[1].shape[:2]
    unit = np.empty((down, across, PER_UNIT, 64), np.int16)
    unit[:, :, :4] = coefs[0].reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    unit[:, :, 4], unit[:, :, 5] = coefs[1], coefs[2]
    flat = unit.reshape(-1)[:size]
    return np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(kind: int, slot: int, lengths: list[int], symbols: bytes) -> bytes:
    """lengths[k]: how many codes have k + 1 bits."""
    return segment(0xC4, bytes([kind << 4 | slot, *lengths, *symbols]))


def stuffed(data: np.ndarray) -> bytes:
    """A zero byte after each byte 255."""
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def pack_bits(bits: np.ndarray) -> bytes:
    """Bits filled up with ones to whole bytes."""
    packed = np.packbits(bits)
    if len(bits) % 8:
        packed[-1] |= 0xFF >> len(bits) % 8
    return stuffed(packed)


def bits_of(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The low ``widths`` bits of each value, highest first, one after the other."""
    ends = np.cumsum(widths)
    at = np.arange(ends[-1] if len(ends) else 0)
    which = np.repeat(np.arange(len(widths)), widths)
    return (values[which] >> (ends[which] - 1 - at) & 1).astype(np.uint8)


#: DC categories 0 to 11 all have codes of four bits; 1111 stays unused, as the standard asks.
DC_TABLE = ([0, 0, 0, 12] + [0] * 12, bytes(range(12)))


def scan_header(components: list[int], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return segment(0xDA, body)


def write(payload: bytes) -> bytes:
    """The payload (a multiple of 64 bytes) as a progressive JPEG file."""
    coefs, across, down = place(payload)
    out = [b"\xff\xd8", segment(0xDB, b"\0" + b"\1" * 64)]
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in SAMPLING)
    out.append(segment(0xC2, frame))
    # DC: interleaved by unit, differences within each component, low bit left out.
    dc = [c[:, :, 0] >> 1 for c in coefs]
    units = np.empty((down, across, PER_UNIT), np.int64)
    units[:, :, :4] = dc[0].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(down, across, 4)
    units[:, :, 4], units[:, :, 5] = dc[1], dc[2]
    flat, diff = units.reshape(-1, PER_UNIT), np.empty((across * down, PER_UNIT), np.int64)
    for part in (slice(0, 4), slice(4, 5), slice(5, 6)):
        run = flat[:, part].ravel()
        diff[:, part] = np.diff(run, prepend=0).reshape(-1, part.stop - part.start)
    diff = diff.ravel()
    size = np.frexp(np.abs(diff))[1].astype(np.int64)  # bits of the magnitude
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    out += [huffman_segment(0, 0, *DC_TABLE), scan_header([1, 2, 3], 0, 0, 0, 1), pack_bits(bits_of(size << size | extra, 4 + size))]
    # AC first: every coefficient is run 0, category 7: code 0 and seven bits, one byte.
    out.append(huffman_segment(1, 0, [1] + [0] * 15, b"\x07"))
    for (name, _, _), c in zip(SAMPLING, coefs):
        for first, last in BANDS:
            band = c[:, :, first : last + 1].reshape(-1)
            half = (np.abs(band) >> 1).astype(np.uint8)
            out += [scan_header([name], first, last, 0, 1), stuffed(np.where(band > 0, half, half ^ 127))]
    # Refinements: the low bit of each magnitude (of the value itself in DC); in AC after an end-of-band code per block.
    low = np.empty((down, across, PER_UNIT), np.uint8)
    low[:, :, :4] = (coefs[0][:, :, 0] & 1).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(down, across, 4)
    low[:, :, 4], low[:, :, 5] = coefs[1][:, :, 0] & 1, coefs[2][:, :, 0] & 1
    out += [scan_header([1, 2, 3], 0, 0, 1, 0), pack_bits(low.ravel()), huffman_segment(1, 0, [1] + [0] * 15, b"\x00")]
    for (name, _, _), c in zip(SAMPLING, coefs):
        for first, last in BANDS:
            bits = np.zeros((c.shape[0] * c.shape[1], last - first + 2), np.uint8)
            bits[:, 1:] = (c[:, :, first : last + 1] & 1).reshape(-1, last - first + 1)  # of -x as of x
            out += [scan_header([name], first, last, 1, 0), pack_bits(bits.ravel())]
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- reading


class Bits:
    """Bits of one scan, stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            chunk = self.data[self.at : self.at + 32]
            self.at += 32
            chunk = chunk + b"\xff" * (32 - len(chunk))
            self.held = (self.held & (1 << self.n) - 1) << 256 | int.from_bytes(chunk, "big")
            self.n += 256
        self.n -= k
        return self.held >> self.n & (1 << k) - 1

    def peek16(self) -> int:
        v = self.take(16)
        self.n += 16
        return v


class Huffman:
    """symbol and code length for every 16 bits that may follow."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.table: dict[int, tuple[int, int]] = {}
        self.lengths, self.symbols = lengths, symbols
        code, k = 0, 0
        for size, count in enumerate(lengths, 1):
            for _ in range(count):
                self.table[size << 16 | code] = (symbols[k], size)
                code, k = code + 1, k + 1
            code <<= 1
        self.sizes = [i for i, c in enumerate(lengths, 1) if c]
        #: The only symbol, if its code is the single bit 0.
        self.only = symbols[0] if len(symbols) == 1 and lengths[0] == 1 else None

    def read(self, bits: Bits) -> int:
        ahead = bits.peek16()
        for size in self.sizes:
            hit = self.table.get(size << 16 | ahead >> 16 - size)
            if hit:
                bits.n -= size
                return hit[0]
        raise ValueError("no such code")


def extend(bits: int, size: int) -> int:
    """A value from its category and extra bits."""
    return bits if size == 0 or bits >> size - 1 else bits - (1 << size) + 1


def extended(bits: np.ndarray, size: int) -> np.ndarray:
    return np.where(bits >> size - 1, bits, bits - (1 << size) + 1)


def scan_data(raw: bytes, start: int) -> tuple[list[bytes], int]:
    """Entropy-coded data from ``start``, cut at restart markers, without stuffing; where the next segment begins."""
    at = start
    cuts = []
    while True:
        at = raw.index(b"\xff", at)
        after = raw[at + 1]
        if after == 0:
            at += 2
        elif 0xD0 <= after <= 0xD7:
            cuts.append(at)
            at += 2
        else:
            break
    edges = [start, *(x for c in cuts for x in (c, c + 2)), at]
    return [raw[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(edges[::2], edges[1::2])], at


class Reader:
    """Accumulates the scans of a progressive file into coefficient arrays, in zigzag order."""

    def __init__(self, raw: bytes, general: bool = False):
        self.raw, self.general = raw, general
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, Huffman] = {}
        self.restart = 0
        self.fast_scans = 0
        at = 2
        while raw[at + 1] != 0xD9:
            marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("16-bit quantisers are not read")
                    self.quant[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.float32), body[65:]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]], body = Huffman(body[1:17], body[17 : 17 + n]), body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self.frame(body)
            elif marker == 0xDA:
                parts, at = scan_data(raw, at)
                self.scan(body, parts)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("only progressive Huffman files are read")

    def frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8:
            raise ValueError("only 8-bit samples are read")
        self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        self.h_most, self.v_most = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        self.across, self.down = -(-self.width // (8 * self.h_most)), -(-self.height // (8 * self.v_most))
        self.coefs = {c: np.zeros((self.down * v, self.across * h, 64), np.int16) for c, (h, v, _) in self.parts.items()}

    def order(self, names: list[int]) -> list[list[tuple[int, int, int]]]:
        """Blocks (component, row, column) of each unit of a scan: its own rows if it has one component only."""
        if len(names) == 1:
            h, v, _ = self.parts[names[0]]
            wide, high = -(-(-(-self.width * h // self.h_most)) // 8), -(-(-(-self.height * v // self.v_most)) // 8)
            return [[(names[0], r, c)] for r in range(high) for c in range(wide)]
        return [[(n, y * self.parts[n][1] + r, x * self.parts[n][0] + c) for n in names for r in range(self.parts[n][1]) for c in range(self.parts[n][0])] for y in range(self.down) for x in range(self.across)]

    def scan(self, body: bytes, parts: list[bytes]) -> None:
        n = body[0]
        which = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(n)}
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        names = list(which)
        if first and not self.general and len(parts) == 1 and self.uniform(names[0], self.tables[16 | which[names[0]] & 15], first, last, high, low, parts[0]):
            self.fast_scans += 1
            return
        if not first and high and not self.general and len(parts) == 1:
            self.refine_dc(names, low, parts[0])
            return
        units = self.order(names)
        step = self.restart or len(units)
        for k, data in enumerate(parts):
            bits, mine = Bits(data), units[k * step : (k + 1) * step]
            if not first:
                self.dc(bits, mine, which, high, low)
            elif high:
                self.refine_ac(bits, mine, self.tables[16 | which[names[0]] & 15], first, last, low)
            else:
                self.first_ac(bits, mine, self.tables[16 | which[names[0]] & 15], first, last, low)

    # Fixed-width scans

    def grid(self, name: int) -> tuple[slice, slice]:
        h, v, _ = self.parts[name]
        return slice(0, -(-(-(-self.height * v // self.v_most)) // 8)), slice(0, -(-(-(-self.width * h // self.h_most)) // 8))

    def uniform(self, name: int, codes: Huffman, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Reads an AC scan in which every symbol is the single-bit code; False if it is another kind of scan."""
        if codes.only is None:
            return False
        rows, columns = self.grid(name)
        view = self.coefs[name][rows, columns, first : last + 1]
        run, size = codes.only >> 4, codes.only & 15
        count, width = view.size, 1 + size
        if not high:
            if run or not size or len(data) != -(-count * width // 8):
                return False
            if width == 8:
                fields = np.frombuffer(data, np.uint8).astype(np.int16)
            else:
                bits = np.unpackbits(np.frombuffer(data, np.uint8))[: count * width].reshape(-1, width)
                fields = bits @ (1 << np.arange(width - 1, -1, -1))
            if fields.max(initial=0) >> size:
                return False
            view += (extended(fields if width == 8 else fields.astype(np.int32), size) << low).reshape(view.shape).astype(np.int16)
            return True
        blocks = view.shape[0] * view.shape[1]
        width = 1 + last - first + 1
        if codes.only or not view.all() or len(data) != -(-blocks * width // 8):
            return False
        bits = np.unpackbits(np.frombuffer(data, np.uint8))[: blocks * width].reshape(blocks, width)
        if bits[:, 0].any():
            return False
        view += np.sign(view) * (bits[:, 1:].reshape(view.shape).astype(np.int16) << low)
        return True

    def refine_dc(self, names: list[int], low: int, data: bytes) -> None:
        """One bit for each block in the order of the scan."""
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(np.int16)
        if len(names) == 1:
            rows, columns = self.grid(names[0])
            view = self.coefs[names[0]][rows, columns, 0]
            view |= bits[: view.size].reshape(view.shape) << low
            return
        per = sum(self.parts[n][0] * self.parts[n][1] for n in names)
        units, at = bits[: per * self.down * self.across].reshape(self.down, self.across, per), 0
        for n in names:
            h, v, _ = self.parts[n]
            own = units[:, :, at : at + h * v].reshape(self.down, self.across, v, h).transpose(0, 2, 1, 3)
            self.coefs[n][:, :, 0] |= own.reshape(self.down * v, self.across * h) << low
            at += h * v

    # Symbol by symbol

    def dc(self, bits: Bits, units: list, which: dict[int, int], high: int, low: int) -> None:
        before = dict.fromkeys(which, 0)
        for unit in units:
            for name, r, c in unit:
                if high:
                    self.coefs[name][r, c, 0] |= bits.take(1) << low
                else:
                    size = self.tables[which[name] >> 4].read(bits)
                    before[name] += extend(bits.take(size), size)
                    self.coefs[name][r, c, 0] = before[name] << low

    def first_ac(self, bits: Bits, units: list, codes: Huffman, first: int, last: int, low: int) -> None:
        skip = 0
        for ((name, r, c),) in units:
            if skip:
                skip -= 1
                continue
            block, k = self.coefs[name][r, c], first
            while k <= last:
                symbol = codes.read(bits)
                run, size = symbol >> 4, symbol & 15
                if size:
                    k += run
                    block[k] = extend(bits.take(size), size) << low
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.take(run) - 1
                    break

    def refine_ac(self, bits: Bits, units: list, codes: Huffman, first: int, last: int, low: int) -> None:
        skip, one = 0, 1 << low
        for ((name, r, c),) in units:
            block, k = self.coefs[name][r, c], first
            while k <= last and not skip:
                symbol = codes.read(bits)
                run, size = symbol >> 4, symbol & 15
                fresh = 0
                if size:
                    fresh = one if bits.take(1) else -one
                elif run != 15:
                    skip = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if block[k]:
                        if bits.take(1):
                            block[k] += one if block[k] > 0 else -one
                    elif run:
                        run -= 1
                    else:
                        block[k] = fresh
                        k += 1
                        break
                    k += 1
            if skip:
                for k in range(k, last + 1):
                    if block[k] and bits.take(1):
                        block[k] += one if block[k] > 0 else -one
                skip -= 1


def read_coefficients(raw: bytes, general: bool = False) -> Reader:
    return Reader(raw, general)


_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)], np.float32)


def planes(file: Reader) -> list[np.ndarray]:
    """Samples of each component, as bytes."""
    out = []
    for name, (_, _, q) in file.parts.items():
        c = file.coefs[name]
        natural = np.empty(c.shape, np.float32)
        natural[:, :, ZIGZAG] = c * file.quant[q]
        pixels = _BASIS.T @ natural.reshape(*c.shape[:2], 8, 8) @ _BASIS
        pixels += 128
        np.rint(pixels, out=pixels)
        out.append(pixels.clip(0, 255, out=pixels).astype(np.uint8).transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, c.shape[1] * 8))
    return out


def rgb(file: Reader) -> np.ndarray:
    """The full-resolution tensor (height, width, 3); chroma is repeated up to the size of luma."""
    full = []
    for plane, (h, v, _) in zip(planes(file), file.parts.values()):
        up = plane.repeat(file.v_most // v, axis=0).repeat(file.h_most // h, axis=1)
        full.append(up[: file.height, : file.width].astype(np.float32))
    if len(full) == 1:
        return np.repeat(full[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, c in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        np.rint(c, out=c)
        out[:, :, k] = c.clip(0, 255, out=c)
    return out


def feature(tensor: np.ndarray) -> str:
    """Size and mean of each channel, in thousandths."""
    h, w = tensor.shape[:2]
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // max(h * w, 1)
    return f"{w}x{h} r={means[0]} g={means[1]} b={means[2]}"


# ---------------------------------------------------------------- columns


def _batches(df: DataFrame, source: str, added: dict[str, tuple[pa.DataType, str]], f, rows: int) -> DataFrame:
    """Adds columns by Arrow batches; one whose name is taken comes under a free one."""
    at, kinds = position(df, source), [kind for kind, _ in added.values()]
    fresh = [StructField(free_name(df, k), DataType.fromDDL(s)) for k, (_, s) in added.items()]
    schema = StructType([*(StructField(x.name, x.dataType) for x in df.schema.fields), *fresh])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                made = [f(x) for x in batch.column(at).to_pylist()]
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return plain_names(df).mapInArrow(run, schema)


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds n_bytes (of the text) and the JPEG file that holds it."""

    def one(t: str | None) -> tuple[int, bytes]:
        raw = (t or "").encode("utf-8", "surrogatepass")
        return len(raw), write(pad(raw))

    return _batches(docs, text, {"n_bytes": (pa.int64(), "bigint"), media: (pa.binary(), "binary")}, one, 64)


def load(docs: DataFrame, media: str = "media", tensor: bool = True) -> DataFrame:
    """Reads files back: adds payload, feature and, if asked for, tensor (RGB bytes, row by row), height and width.

    The payload has as many blocks as the image; ``cut_payload`` takes it to its own length.
    """
    added = {"payload": (pa.binary(), "binary"), "feature": (pa.string(), "string")}
    if tensor:
        added |= {"tensor": (pa.binary(), "binary"), "height": (pa.int32(), "int"), "width": (pa.int32(), "int")}

    def one(raw: bytes) -> tuple:
        file = read_coefficients(raw)
        coefs = list(file.coefs.values())
        pixels = rgb(file)
        out = (unplace(coefs, sum(c.size for c in coefs)), feature(pixels))
        return (*out, pixels.tobytes(), file.height, file.width) if tensor else out

    return _batches(docs, media, added, one, 32)


def cut_payload(n_bytes: str = "n_bytes", payload: str = "payload"):
    """The payload without the blocks that fill up the image."""
    size = F.greatest(F.ceil(F.col(n_bytes) / 64), F.lit(1)) * 64
    return F.substring(payload, F.lit(1), size.cast("int"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    back = load(stored).withColumn("payload", cut_payload())
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        F.sha2("tensor", 256).alias("tensor_sha256"),
    )
