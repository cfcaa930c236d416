"""The decoder on progressive files written here scan by scan, by a plain encoder of bits as text."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from barlake.llm import jpeg

#: Every symbol but 255 has a code of eight bits: its own number.
TABLE = bytes([*[0] * 7, 255, *[0] * 8]) + bytes(range(255))


def code(symbol: int) -> str:
    return f"{symbol:08b}"


def value(v: int) -> str:
    size = abs(v).bit_length()
    return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""


def packed(bits: str) -> bytes:
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


def ends(run: int, later: str = "") -> str:
    """An end of band over ``run`` blocks, and the correction bits that were held back."""
    n = run.bit_length() - 1
    return code(n << 4) + (f"{run - (1 << n):0{n}b}" if n else "") + later if run else ""


def first_scan(blocks, low: int) -> str:
    out, run = "", 0
    for b in blocks:
        zeros = 0
        for c in (int(np.sign(x)) * (abs(int(x)) >> low) for x in b[1:]):
            if not c:
                zeros += 1
                continue
            out, run = out + ends(run), 0
            out += code(0xF0) * (zeros // 16) + code((zeros % 16) << 4 | abs(c).bit_length()) + value(c)
            zeros = 0
        run += zeros > 0
    return out + ends(run)


def refining_scan(blocks) -> str:
    """The last bit of each coefficient: those that were zero come with their run of zeros, the others as one bit."""
    out, run, held = "", 0, ""
    for b in blocks:
        size = [abs(int(x)) for x in b]
        new = max((k for k in range(1, 64) if size[k] == 1), default=0)
        zeros, bits = 0, ""
        for k in range(1, 64):
            if not size[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= new:
                out, run, held = out + ends(run, held) + code(0xF0) + bits, 0, ""
                zeros, bits = zeros - 16, ""
            if size[k] > 1:
                bits += str(size[k] & 1)
            else:
                out, run, held = out + ends(run, held) + code(zeros << 4 | 1) + str(int(b[k] > 0)) + bits, 0, ""
                zeros, bits = 0, ""
        if zeros or bits:
            run, held = run + 1, held + bits
    return out + ends(run, held)


def image(seed: int, sampling: list[tuple[int, int]], width: int, height: int, restart: int):
    """(file as segments, coefficients of each component as (rows, columns, 64) in zigzag order)."""
    draw = np.random.default_rng(seed)
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    parts, owns = [], []
    for h, v in sampling:
        own = -(-height * v // (8 * vmax)), -(-width * h // (8 * hmax))
        c = np.zeros((down * v, across * h, 64), int)
        c[..., 0] = draw.integers(-200, 200, c.shape[:2])
        some = draw.random((*own, 63)) < draw.choice([0.0, 0.03, 0.4, 1.0], (*own, 1))
        c[: own[0], : own[1], 1:] = np.where(some, draw.integers(-12, 13, (*own, 63)), 0)
        parts.append(c)
        owns.append(own)
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out = [segment(0xDB, b"\0" + bytes(range(1, 65))), segment(0xC2, frame), segment(0xC4, b"\x00" + TABLE), segment(0xC4, b"\x10" + TABLE), segment(0xDD, struct.pack(">H", restart))]

    def scan(of: list[int], first: int, last: int, old: int, low: int, pieces: list[str]) -> None:
        out.append(segment(0xDA, bytes([len(of), *[x for i in of for x in (i + 1, 0)], first, last, old << 4 | low])))
        for k, bits in enumerate(pieces):
            out[-1] += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + packed(bits)

    units = [[(i, y * v + dy, x * h + dx) for i, (h, v) in enumerate(sampling) for dy in range(v) for dx in range(h)] for y in range(down) for x in range(across)]
    if len(parts) == 1:
        units = [[(0, y, x)] for y in range(owns[0][0]) for x in range(owns[0][1])]
        parts[0][owns[0][0] :], parts[0][:, owns[0][1] :] = 0, 0
    cut = lambda rows: [rows[i : i + restart] for i in range(0, len(rows), restart)] if restart else [rows]
    pieces = []
    for some in cut(units):
        last, bits = dict.fromkeys(range(len(parts)), 0), ""
        for i, y, x in (b for unit in some for b in unit):
            dc = int(parts[i][y, x, 0]) >> 1
            bits += code(abs(dc - last[i]).bit_length()) + value(dc - last[i])
            last[i] = dc
        pieces.append(bits)
    every = list(range(len(parts)))
    scan(every, 0, 0, 0, 1, pieces)
    own = [[c[y, x] for y in range(o[0]) for x in range(o[1])] for c, o in zip(parts, owns, strict=True)]
    for i in every:
        scan([i], 1, 63, 0, 1, [first_scan(b, 1) for b in cut(own[i])])
    scan(every, 0, 0, 1, 0, ["".join(str(int(parts[i][y, x, 0]) & 1) for unit in some for i, y, x in unit) for some in cut(units)])
    for i in every:
        scan([i], 1, 63, 1, 0, [refining_scan(b) for b in cut(own[i])])
    return [b"\xff\xd8", *out, b"\xff\xd9"], parts


def plain_rgb(parts, sampling, width: int, height: int) -> np.ndarray:
    """The inverse transform as its double sum, one sample of each component for each pixel."""
    k = np.arange(8)
    wave = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, 0.5**0.5, 1.0) / 2
    at = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = []
    for c, (h, v) in zip(parts, sampling, strict=True):
        plane = np.zeros((c.shape[0] * 8, c.shape[1] * 8))
        for y in range(c.shape[0]):
            for x in range(c.shape[1]):
                f = np.zeros((8, 8))
                for i, (r, s) in enumerate(at):
                    f[r, s] = c[y, x, i] * (i + 1)
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = wave @ f @ wave.T
        plane = np.clip(np.rint(plane + 128), 0, 255)
        planes.append(np.array([[plane[y * v // vmax, x * h // hmax] for x in range(width)] for y in range(height)]))
    if len(planes) == 1:
        return np.stack(planes * 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)), 0, 255)


CASES = [([(2, 2), (1, 1), (1, 1)], 45, 37, 0), ([(2, 1), (1, 1), (1, 1)], 50, 21, 2), ([(1, 2), (1, 1), (1, 1)], 19, 40, 3), ([(1, 1), (1, 1), (1, 1)], 24, 17, 5), ([(1, 1)], 30, 20, 4), ([(2, 2)], 30, 20, 0)]


@pytest.mark.parametrize(("sampling", "width", "height", "restart"), CASES)
def test_scans(sampling, width, height, restart):
    """Interleaved scans, restarts, runs of zeros and of blocks, both refinements, and fill bytes before every marker."""
    for seed in range(4):
        parts, want = image(seed, sampling, width, height, restart)
        decoder = jpeg.Decoder(b"".join(parts))
        for c, w in zip(decoder.parts, want, strict=True):
            found = c.blocks.reshape(c.high, c.wide, 64)[: w.shape[0], : w.shape[1]]
            assert (found == w[: found.shape[0], : found.shape[1]]).all()
        filled = jpeg.Decoder(b"\xff\xd8" + b"".join(b"\xff" * (k % 3) + p for k, p in enumerate(parts[1:])))
        assert all((a.blocks == b.blocks).all() for a, b in zip(decoder.parts, filled.parts, strict=True))
    apart = np.abs(decoder.rgb().astype(int) - plain_rgb(want, sampling, width, height))
    assert apart.max() <= 2 and (apart > 0).mean() < 0.01


def test_fill_bytes_before_restarts():
    parts, _ = image(1, *CASES[1][:3], 2)
    whole = b"".join(parts)
    filled = whole
    for k in range(8):
        filled = filled.replace(bytes([0xFF, 0xD0 + k]), bytes([0xFF, 0xFF, 0xD0 + k]))
    assert filled != whole
    assert all((a.blocks == b.blocks).all() for a, b in zip(jpeg.Decoder(whole).parts, jpeg.Decoder(filled).parts, strict=True))
    with pytest.raises((ValueError, IndexError)):
        jpeg.Decoder(whole[:2] + b"\x00" + whole[2:])
