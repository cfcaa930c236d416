"""Progressive JPEG as a media column: scans accumulate into coefficient arrays, numpy makes full-resolution RGB of them.

Decoding follows the format: markers, Huffman tables, then scan after scan. DC scans and AC bands (spectral selection)
write high bits first, refinement scans (successive approximation) add a bit each; interleaved and single-component
scans, restart intervals, end-of-band runs and any sampling factors are handled. Coefficients times the quantiser go
through the inverse transform as one matrix product, chroma is repeated to full size, YCbCr becomes RGB.

``encode`` stores bytes losslessly in the format's unit, the quantised coefficient: a byte b is the coefficient b + 256,
64 of them a block, in three components with chroma at half size (six blocks an MCU, missing ones filled with byte 0). All
AC coefficients without their lowest bit are then eight bits long, so that one Huffman code of one bit serves them, and
scans like these are read and written without a loop over symbols. A file has ten scans: DC of each component, then the
AC coefficients without their lowest bit (luma 1-5, chroma 1-63, luma 6-63), then their lowest bits.

Null or empty text: a payload of 64 zero bytes. Null ids are kept, repeated rows are done each, an empty table gives an
empty table; other columns are not used.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames

UNIT = 64


def _zigzag() -> np.ndarray:
    """Position in the 8 x 8 block of each coefficient in stream order: along diagonals, turning at the edges."""
    cells = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([u * 8 + v for u, v in cells])


ZIGZAG = _zigzag()
_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5 / np.sqrt(2)) for x in range(8)] for u in range(8)])
#: Coefficients (row-major) to samples, as one matrix.
INVERSE = np.kron(_BASIS, _BASIS).astype(np.float32)
#: The same for coefficients in stream order.
_OF_STREAM = INVERSE[ZIGZAG]


# ---- reading -------------------------------------------------------------------------------------------------------


_SHIFTS = np.arange(8, 0, -1, dtype=np.uint32)


class Bits:
    """The bits of one entropy-coded segment, stuffing removed; ones follow its end."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        self.raw, self.size, self.at = np.frombuffer(self.data, np.uint8), 8 * len(self.data), 0
        self._bits: np.ndarray | None = None
        self._words: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        """All bits; made where a scan reads them one by one."""
        if self._bits is None:
            self._bits = np.unpackbits(self.raw)
        return self._bits

    def peek(self, n: int) -> int:
        """The next ``n`` (at most 16) bits as a number, without going on."""
        if self.at + n > self.size:
            raise ValueError("data end within a scan")
        lo = self.at >> 3
        return int.from_bytes(self.data[lo : lo + 3].ljust(3, b"\xff"), "big") >> (24 - (self.at & 7) - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def peeks(self) -> np.ndarray:
        """The 16 bits that start at every position."""
        if self._words is None:
            raw = self.raw.astype(np.uint32)
            three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
            self._words = ((three[:, None] >> _SHIFTS) & 0xFFFF).ravel()
        return self._words

    def fields(self, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Unsigned values of up to 16 bits at many positions."""
        return (self.peeks()[starts].astype(np.int64) >> (16 - widths)) * (widths > 0)

    def even(self, count: int, skip: int, width: int) -> np.ndarray:
        """``count`` values of ``width`` (1 to 16) bits, each after ``skip`` other bits."""
        rows = self.bits[self.at : self.at + count * (skip + width)].reshape(count, skip + width)[:, skip:]
        if width == 8:
            self.at += count * (skip + width)
            return np.packbits(rows).astype(np.int16)
        packed = np.packbits(rows, axis=1).astype(np.int32)
        self.at += count * (skip + width)
        return packed[:, 0] >> (8 - width) if width <= 8 else (packed[:, 0] << 8 | packed[:, 1]) >> (16 - width)


class Table:
    """A Huffman table: symbol and code length for every 16-bit prefix."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(65536, np.int16), np.zeros(65536, np.int16)
        code = k = 0
        for size, count in enumerate(counts, 1):
            for _ in range(count):
                lo = code << (16 - size)
                self.symbol[lo : lo + (1 << (16 - size))], self.length[lo : lo + (1 << (16 - size))] = symbols[k], size
                code, k = code + 1, k + 1
            code <<= 1
        #: The one symbol, if there is only one, and its code's length: then all steps are equal.
        self.only = (symbols[0], next(i for i, c in enumerate(counts, 1) if c)) if len(symbols) == 1 else None

    def next(self, bits: Bits) -> int:
        w = bits.peek(16) if bits.at < bits.size - 16 else 0xFFFF
        if not self.length[w]:
            raise ValueError("no such Huffman code")
        bits.at += int(self.length[w])
        return int(self.symbol[w])


@functools.lru_cache(64)
def table_of(counts: bytes, symbols: bytes) -> Table:
    """Files made alike share their tables."""
    return Table(counts, symbols)


def _signed(v: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Magnitude bits to signed values."""
    return np.where(v < (1 << np.maximum(width - 1, 0)), v - (1 << width) + 1, v) * (width > 0)


def _chain(bits: Bits, table: Table, count: int) -> np.ndarray:
    """Signed values of ``count`` symbols that are each followed by (symbol & 15) bits."""
    if table.only and table.only[0] & 15:
        symbol, n = table.only
        v, width = bits.even(count, n, symbol & 15), symbol & 15
        return np.where(v >> (width - 1), v, v - (1 << width) + 1)
    w = bits.peeks()
    size, sym = table.length[w], table.symbol[w]
    step = (size + (sym & 15)).tolist()
    at, places = bits.at, []
    for _ in range(count):
        places.append(at)
        at += step[at]
    bits.at = at
    p = np.array(places, np.int64)
    width = (sym[p] & 15).astype(np.int64)
    return _signed(bits.fields(p + size[p], width), width)


@functools.lru_cache(256)
def _rows(wide: int, high: int, stored: int) -> np.ndarray:
    """Numbers of the blocks of a component's own scan; ``stored``: blocks a stored row has."""
    return (np.arange(high)[:, None] * stored + np.arange(wide)).ravel()


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q = ident, h, v, q


class Decoder:
    """A progressive (or its special case, one-scan-a-band) JPEG; ``coefficients`` fill up scan by scan."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], Table] = {}
        self.parts: list[Component] = []
        self.restart, self.comment, self.scans = 0, b"", 0
        at = 2
        self.ended = False
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker where one is due")
            while data[at + 1] == 0xFF:  # fill bytes before a marker
                at += 1
            mark = data[at + 1]
            if mark == 0xD9:
                self.ended = True
                break
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                self._quant(body)
            elif mark == 0xC4:
                self._huffman(body)
            elif mark == 0xC2:
                self._frame(body)
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise ValueError("not a progressive JPEG")
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xFE:
                self.comment = body
            elif mark == 0xDA:
                segments, at = self._segments(data, at)
                self._scan(body, segments)
        if not self.ended or not self.parts:
            raise ValueError("not a whole JPEG")

    @staticmethod
    def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
        """Entropy-coded data up to the next marker, cut at restart markers."""
        out, start = [], at
        while True:
            at = mark = data.index(b"\xff", at)
            while data[mark] == 0xFF:  # fill bytes before a marker
                mark += 1
            if data[mark] == 0:
                at = mark + 1
            elif 0xD0 <= data[mark] <= 0xD7:
                out.append(data[start:at])
                at = start = mark + 1
            else:
                return [*out, data[start:at]], at

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            values = np.frombuffer(body[at + 1 : at + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
            self.quant[ident] = np.zeros(64, np.float32)
            self.quant[ident][ZIGZAG] = values
            at += 1 + 64 * (1 + wide)

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            self.tables[body[at] >> 4, body[at] & 15] = table_of(counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.mcus = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.parts:
            c.wide, c.high = self.mcus[0] * c.h, self.mcus[1] * c.v  # stored blocks
            c.own = -(-(-(-self.width * c.h // self.hmax)) // 8), -(-(-(-self.height * c.v // self.vmax)) // 8)  # in its own scans
            c.blocks = np.zeros((c.wide * c.high, 64), np.int16)  # stream order

    def _order(self, parts: list[Component]) -> list[tuple[Component, np.ndarray]]:
        """For each component its block numbers in the order of the scan."""
        if len(parts) == 1:
            c = parts[0]
            return [(c, _rows(*c.own, c.wide))]
        out = []
        for c in parts:
            y, x, v, h = np.ix_(np.arange(self.mcus[1]), np.arange(self.mcus[0]), np.arange(c.v), np.arange(c.h))
            out.append((c, ((y * c.v + v) * c.wide + x * c.h + h).reshape(-1, c.v * c.h)))
        return out

    def _scan(self, body: bytes, segments: list[bytes]) -> None:
        n = body[0]
        chosen = [(next(c for c in self.parts if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, old, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        order = self._order([c for c, _ in chosen])
        units = len(order[0][1])
        step = self.restart or units
        self.scans += 1
        for i, segment in enumerate(segments):
            span, bits = slice(i * step, min(units, (i + 1) * step)), Bits(segment)
            if first == 0:
                (self._dc_refine if old else self._dc)(bits, [(c, o[span], t) for (c, o), (_, t) in zip(order, chosen, strict=True)], low)
            else:
                c, blocks = order[0][0], order[0][1][span]
                table = self.tables[1, chosen[0][1] & 15]
                (self._ac_refine if old else self._ac)(bits, c, blocks, table, first, last, low)

    def _dc(self, bits: Bits, parts: list, low: int) -> None:
        if len(parts) == 1:
            c, blocks, t = parts[0]
            c.blocks[blocks, 0] = np.cumsum(_chain(bits, self.tables[0, t >> 4], len(blocks))) << low
            return
        last = [0] * len(parts)
        for unit in range(len(parts[0][1])):
            for k, (c, blocks, t) in enumerate(parts):
                for b in blocks[unit]:
                    size = self.tables[0, t >> 4].next(bits)
                    v = bits.take(size)
                    last[k] += v - (1 << size) + 1 if size and v < 1 << (size - 1) else v
                    c.blocks[b, 0] = last[k] << low

    def _dc_refine(self, bits: Bits, parts: list, low: int) -> None:
        if len(parts) == 1:
            c, blocks, _ = parts[0]
            c.blocks[blocks, 0] |= bits.bits[bits.at : bits.at + len(blocks)].astype(np.int16) << low
            return
        for unit in range(len(parts[0][1])):
            for c, blocks, _ in parts:
                for b in blocks[unit]:
                    c.blocks[b, 0] |= bits.take(1) << low

    def _ac(self, bits: Bits, c: Component, blocks: np.ndarray, table: Table, first: int, last: int, low: int) -> None:
        width = last - first + 1
        if table.only and table.only[0] < 16 and table.only[0]:  # no zero runs, no ends of band: every coefficient is coded
            c.blocks[blocks, first : last + 1] = (_chain(bits, table, len(blocks) * width) << low).reshape(-1, width)
            return
        run = 0
        for b in blocks.tolist():
            if run:
                run -= 1
                continue
            k, row = first, c.blocks[b]
            while k <= last:
                s = table.next(bits)
                zeros, size = s >> 4, s & 15
                if size:
                    k += zeros
                    v = bits.take(size)
                    row[k] = (v if v >> (size - 1) else v - (1 << size) + 1) << low
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) - 1 + bits.take(zeros)
                    break

    @staticmethod
    def _correct(bits: Bits, c: Component, blocks: np.ndarray, first: int, last: int, bit: int) -> None:
        """A correction bit for each nonzero coefficient of whole bands."""
        band = c.blocks[blocks, first : last + 1]
        if band.all():
            more = bits.bits[bits.at : bits.at + band.size].reshape(band.shape) * np.int16(bit)
            bits.at += band.size
            more &= ~(np.abs(band) & np.int16(bit))
            c.blocks[blocks, first : last + 1] = band + more * (band >> 15 | 1)
            return
        some = band != 0
        n = int(some.sum())
        more = bits.bits[bits.at : bits.at + n].astype(np.int16) * bit
        bits.at += n
        values = band[some]
        band[some] = values + np.where(np.abs(values) & bit, 0, np.sign(values) * more)
        c.blocks[blocks, first : last + 1] = band

    def _ac_refine(self, bits: Bits, c: Component, blocks: np.ndarray, table: Table, first: int, last: int, low: int) -> None:
        bit, i = 1 << low, 0
        while i < len(blocks):
            row, k, run = c.blocks[blocks[i]], first, 0
            while k <= last:
                s = table.next(bits)
                zeros, value = s >> 4, 0
                if s & 15:
                    value = bit if bits.take(1) else -bit
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= last:
                    if row[k]:
                        self._correct(bits, c, blocks[i : i + 1], k, k, bit)
                    elif zeros:
                        zeros -= 1
                    else:
                        row[k] = value
                        k += 1
                        break
                    k += 1
            if run and k == first:
                self._correct(bits, c, blocks[i : i + run], first, last, bit)
            elif run:  # this block from k on, then run - 1 whole ones
                if k <= last:
                    self._correct(bits, c, blocks[i : i + 1], k, last, bit)
                self._correct(bits, c, blocks[i + 1 : i + run], first, last, bit)
            i += max(1, run)

    def rgb(self) -> np.ndarray:
        """The image, (height, width, 3) of bytes; one component is repeated thrice."""
        planes = []
        for c in self.parts:
            samples = (c.blocks * self.quant[c.q][ZIGZAG]) @ _OF_STREAM
            samples += 128
            samples = np.clip(np.rint(samples, out=samples), 0, 255, out=samples).reshape(c.high, c.wide, 8, 8)
            plane = samples.transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
            plane = plane.repeat(self.vmax // c.v, 0).repeat(self.hmax // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.stack(planes * 3, 2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)
        for k, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[:, :, k] = np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
        return out


# ---- writing -------------------------------------------------------------------------------------------------------

_EOB = bytes(n << 4 for n in range(15))
#: Bits of numbers below 512.
_SIZES = np.array([n.bit_length() for n in range(512)])


def _segment(mark: int, body: bytes) -> bytes:
    return b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones, zero bytes stuffed after 0xFF."""
    packed = np.packbits(bits)
    packed[-1:] |= (1 << (-len(bits) % 8)) - 1
    return packed.tobytes().replace(b"\xff", b"\xff\x00")


def _fields(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The bits of values of different widths, one after the other."""
    ends = np.cumsum(widths)
    place = np.arange(ends[-1]) - np.repeat(ends - widths, widths)
    return ((np.repeat(values, widths) >> (np.repeat(widths, widths) - 1 - place)) & 1).astype(np.uint8)


@functools.lru_cache(4096)
def _runs(blocks: int) -> np.ndarray:
    """Codes for ends of band that reach over ``blocks`` blocks (at most 32767)."""
    n = blocks.bit_length() - 1
    return _fields(np.array([n, blocks - (1 << n)]), np.array([4, n]))


def _nines(values: np.ndarray) -> bytes:
    """Bytes that each follow a bit 0, as ``_entropy`` of their bits."""
    pairs = np.unpackbits(values.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return _entropy(pairs[:, 7:].ravel())


def _scan(ident: int, first: int, last: int, old: int, low: int, entropy: bytes) -> bytes:
    return _segment(0xDA, bytes([1, ident, 0, first, last, old << 4 | low])) + entropy


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload`` (a positive multiple of 64 bytes) as its coefficients."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    mcus = -(-len(blocks) // 6)
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    full = np.zeros((6 * wide * high, 64), np.uint8)
    full[: len(blocks)] = blocks
    luma, area = 4 * wide * high, wide * high
    out = [b"\xff\xd8", _segment(0xFE, b"blocks=%d" % len(blocks)), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    dc, ac = bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12)), bytes([1, *[0] * 15]) + b"\x08"
    out += [_segment(0xC4, b"\x00" + dc), _segment(0xC4, b"\x10" + ac)]
    parts = [(1, full[:luma]), (2, full[luma : luma + area]), (3, full[luma + area :])]
    diff = full[:, 0].astype(np.int64)
    diff[1:] -= full[:-1, 0]
    diff[[0, luma, luma + area]] = full[[0, luma, luma + area], 0].astype(np.int64) + 256
    sizes = _SIZES[np.abs(diff)]
    codes = diff + (diff < 0) * ((1 << sizes) - 1)
    for ident, lo, hi in ((1, 0, luma), (2, luma, luma + area), (3, luma + area, None)):
        size, code = sizes[lo:hi], codes[lo:hi]
        out.append(_scan(ident, 0, 0, 0, 0, _entropy(_fields(size << size | code, size + 4))))
    for ident, first, last in ((1, 1, 5), (2, 1, 63), (3, 1, 63), (1, 6, 63)):
        out.append(_scan(ident, first, last, 0, 1, _nines((parts[ident - 1][1][:, first : last + 1] >> 1 | 128).ravel())))
    out.append(_segment(0xC4, b"\x10" + bytes([0, 0, 0, 15, *[0] * 12]) + _EOB))
    for ident, part in parts:
        pieces = [x for i in range(0, len(part), 32767) for x in (_runs(len(part[i : i + 32767])), part[i : i + 32767, 1:].ravel() & 1)]
        out.append(_scan(ident, 1, 63, 1, 0, _entropy(np.concatenate(pieces))))
    return b"".join([*out, b"\xff\xd9"])


def payload(image: Decoder) -> bytes | None:
    """The bytes that ``encode`` stored, from the coefficients; None for other images."""
    if not image.comment.startswith(b"blocks="):
        return None
    blocks = np.concatenate([c.blocks for c in image.parts])[: int(image.comment.removeprefix(b"blocks="))]
    return (blocks - 256).astype(np.uint8).tobytes()


# ---- columns -------------------------------------------------------------------------------------------------------


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a progressive JPEG."""
    frames.small_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            media = [encode(x + bytes(-len(x) % UNIT if x else UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


MADE = {"payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "scans": pa.int32(), "rgb": pa.binary()}


def decoded(media: bytes | None) -> dict:
    """The values of ``MADE`` for one file; all null where it is null or cannot be read."""
    try:
        image = Decoder(media or b"")
        return {"payload": payload(image), "height": image.height, "width": image.width, "scans": image.scans, "rgb": image.rgb().tobytes()}
    except (ValueError, IndexError, KeyError, AttributeError, StopIteration, struct.error):
        return dict.fromkeys(MADE)


def read(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with payload, height, width, scans and rgb (height * width * 3 bytes) read from the media column.

    Null media, and bytes that are no whole progressive JPEG, give nulls. Columns that clash with these names are replaced.
    """
    frames.small_batches(stored.sparkSession, 128)
    source = stored.select(*[c for c in stored.columns if c == media_col or c not in MADE])
    schema = T.StructType([f for f in source.schema.fields if f.name not in MADE])
    for k, t in (("payload", "binary"), ("height", "integer"), ("width", "integer"), ("scans", "integer"), ("rgb", "binary")):
        schema = schema.add(k, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = [decoded(x) for x in b.column(b.schema.get_field_index(media_col)).to_pylist()]
            own = [(c, k) for c, k in zip(b.columns, b.schema.names, strict=True) if k not in MADE]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in own], *[pa.array([x[k] for x in images], t) for k, t in MADE.items()]], [*[k for _, k in own], *MADE])

    return source.mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: checksums of what was read back and stored, and a feature of the RGB tensor."""
    found = read(store(docs, id_col, text_col))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), F.col("scans"), F.lpad(F.lower(F.hex(F.crc32("rgb"))), 8, "0"))
    return found.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
