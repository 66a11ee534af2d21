"""Media columns: progressive JPEG, read scan by scan into coefficient arrays.

``decode`` reads any 8-bit Huffman-coded progressive stream: spectral selection, successive
approximation, restart intervals, subsampled chroma. Two kinds of scan are read as whole arrays:
those by a code book whose codes and extra bits always take the same number of bits together, and
refinements in which one end-of-band run covers many blocks.

``store`` keeps bytes losslessly as coefficients: a block holds 64 bytes b as 256 + b, all
quantisers are 1. Half of an image's blocks are luma, a quarter each are the two chroma components,
which are half as wide. First scans carry all bits but the lowest, refinement scans the lowest.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks in one image, a multiple of 4: payloads above it become several images, one after the other.
BLOCKS = 4096

# Fixed values of the format: the zigzag order of coefficients (row * 8 + column).
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


def basis() -> np.ndarray:
    """Row k: the 64 samples of coefficient k in zigzag order."""
    x = np.arange(8)
    cos = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("ua,vb->uvab", cos, cos).reshape(64, 64)
    return full[ZIGZAG]


BASIS = basis().astype(np.float32)


class Huffman:
    """A code book: symbol and length for each 16-bit window.

    ``field`` is the number of bits that every code takes with its extra bits, if that is always
    the same and no code stands for a run; ``values`` then has the value of each such field.
    """

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k, spans = 0, 0, set()
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                at = code << (16 - bits)
                self.symbol[at : at + (1 << 16 - bits)], self.length[at : at + (1 << 16 - bits)] = symbols[k], bits
                spans.add(bits + symbols[k] if symbols[k] < 16 else 0)
                code, k = code + 1, k + 1
            code <<= 1
        self.field = spans.pop() if len(spans) == 1 and max(spans) <= 16 else 0
        if self.field:
            window = np.arange(1 << self.field)
            size = self.symbol[window << (16 - self.field)].astype(np.int64)
            self.known = self.length[window << (16 - self.field)] > 0
            extra = window & ((1 << size) - 1)
            self.values = np.where((size > 0) & (extra >> np.maximum(size - 1, 0) == 0), extra - (1 << size) + 1, extra)
            self.zero = bool((symbols[:k].find(0) >= 0))


@lru_cache(maxsize=64)
def book_of(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Bits:
    """The bits of one restart interval; ones follow its end."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff")
        self.raw, self.n, self.at = data + b"\xff" * 8, 8 * len(data), 0
        self.flat = np.unpackbits(np.frombuffer(data, np.uint8))

    def peek(self) -> int:
        return int.from_bytes(self.raw[self.at >> 3 : (self.at >> 3) + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        out = self.flat[self.at : self.at + n]
        self.at += n
        if len(out) < n:
            raise ValueError("the scan ends early")
        return out

    def symbol(self, book: Huffman) -> int:
        w = self.peek()
        n = int(book.length[w])
        if not n or self.at + n > self.n:
            raise ValueError("no such code")
        self.at += n
        return int(book.symbol[w])

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def fields(self, n: int, book: Huffman) -> np.ndarray:
        """The next ``n`` values by a book of even fields."""
        rows = self.many(n * book.field).reshape(n, book.field)
        at = np.zeros(n, np.uint16)
        for i in range(book.field):
            at = at << 1 | rows[:, i]
        if not book.known[at].all():
            raise ValueError("no such code")
        return book.values[at]


def dc_first(b: Bits, book: Huffman, c: np.ndarray, rows: np.ndarray, al: int) -> None:
    diffs = b.fields(len(rows), book) if book.field else [b.signed(b.symbol(book)) for _ in rows]
    c[rows, 0] = np.cumsum(diffs) << al


def ac_first(b: Bits, book: Huffman, c: np.ndarray, rows: np.ndarray, ss: int, se: int, al: int) -> None:
    if book.field and not book.zero:  # no run and no end of band can be coded
        c[rows, ss : se + 1] = (b.fields(len(rows) * (se - ss + 1), book) << al).reshape(len(rows), -1)
        return
    i = 0
    while i < len(rows):
        k, run, block = ss, 0, c[rows[i]]
        while k <= se:
            rs = b.symbol(book)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                block[k] = b.signed(s) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + b.take(r) - 1
                break
        i += 1 + run


def correct(b: Bits, c: np.ndarray, rows: np.ndarray, ss: int, se: int, al: int) -> None:
    """A correction bit for each coefficient of the band that is not 0, block after block."""
    if not len(rows) or ss > se:
        return
    whole = len(rows) == rows[-1] - rows[0] + 1
    part = c[rows[0] : rows[-1] + 1, ss : se + 1] if whole else c[rows, ss : se + 1]
    known = part != 0
    if known.all():
        add = b.many(part.size).reshape(part.shape).astype(part.dtype) << al
        part += add if (part > 0).all() else np.where(part > 0, add, -add)
    else:
        old = part[known]
        add = b.many(len(old)).astype(part.dtype) << al
        part[known] = old + np.where(old > 0, add, -add)
    if not whole:
        c[rows, ss : se + 1] = part


def ac_refine(b: Bits, book: Huffman, c: np.ndarray, rows: np.ndarray, ss: int, se: int, al: int) -> None:
    i = 0
    while i < len(rows):
        k, run, block = ss, 0, c[rows[i]]
        while k <= se:
            rs = b.symbol(book)
            r, s = rs >> 4, rs & 15
            if not s and r < 15:
                run = (1 << r) + b.take(r)
                break
            new = (1 << al if b.take(1) else -(1 << al)) if s else 0
            while k <= se:
                if block[k]:
                    if b.take(1):
                        block[k] += 1 << al if block[k] > 0 else -(1 << al)
                elif r:
                    r -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            correct(b, c, rows[i : i + 1], k, se, al)
            correct(b, c, rows[i + 1 : i + run], ss, se, al)
            i += run
        else:
            i += 1


MARKER = re.compile(rb"\xff[^\x00\xff]")


def segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of the entropy-coded bytes at ``at``, and where the next marker stands."""
    out = []
    for m in MARKER.finditer(data, at):
        out.append(data[at : m.start()])
        if not 0xD0 <= data[m.start() + 1] <= 0xD7:
            return out, m.start()
        at = m.end()
    raise ValueError("the stream ends inside a scan")


class Image:
    """One progressive image: ``coefficients`` per component as (blocks, 64) in zigzag order."""

    def __init__(self, data: bytes, at: int = 0):
        self.tables: dict[int, np.ndarray] = {}
        self.books: dict[int, Huffman] = {}
        self.restart, self.comment = 0, b""
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no image starts here")
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            m = data[at + 1]
            if m == 0xD9:
                self.end = at + 2
                return
            n = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if m == 0xDB:
                while body:
                    wide, t = body[0] >> 4, body[0] & 15
                    self.tables[t] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                    body = body[1 + 64 * (1 + wide) :]
            elif m == 0xC4:
                while body:
                    counts = body[1:17]
                    self.books[body[0]] = book_of(counts, body[17 : 17 + sum(counts)])
                    body = body[17 + sum(counts) :]
            elif m == 0xC2:
                self._frame(body)
            elif m == 0xFE:
                self.comment = body
            elif m == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif m == 0xDA:
                at = self._scan(body, data, at)
            elif m in (0xC0, 0xC1, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and m != 0xCC:
                raise ValueError("not a progressive Huffman-coded frame")

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8:
            raise ValueError("not 8 bits deep")
        self.parts = {}
        spec = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.hmax, self.vmax = max(s[1] >> 4 for s in spec), max(s[1] & 15 for s in spec)
        self.mcux, self.mcuy = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for s in spec:
            h, v = s[1] >> 4, s[1] & 15
            wide, high = self.mcux * h, self.mcuy * v
            own_w, own_h = -(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8)
            self.parts[s[0]] = {"h": h, "v": v, "t": s[2], "wide": wide, "high": high, "own": (own_h, own_w), "c": np.zeros((wide * high, 64), np.int16)}

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        picked = [(self.parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        parts, end = segments(data, at)
        if n == 1:
            p, book = picked[0]
            high, wide = p["own"]
            rows = (np.arange(high)[:, None] * p["wide"] + np.arange(wide)).ravel()
            units, orders = len(rows), [(p, book, rows, 1)]
        else:
            units, orders = self.mcux * self.mcuy, []
            for p, book in picked:
                y, x = np.divmod(np.arange(units), self.mcux)
                own = ((y * p["v"])[:, None, None] + np.arange(p["v"])[:, None]) * p["wide"] + (x * p["h"])[:, None, None] + np.arange(p["h"])
                orders.append((p, book, own.reshape(units, -1), p["h"] * p["v"]))
        step = self.restart or units
        for k, part in enumerate(parts):
            bits, low, high = Bits(part), k * step, min(units, (k + 1) * step)
            if n > 1:
                self._interleaved(bits, orders, low, high, ah, al)
                continue
            p, book, rows, _ = orders[0]
            rows, c = rows[low:high], p["c"]
            if ss == 0:
                if ah:
                    c[rows, 0] |= bits.many(len(rows)).astype(np.int16) << al
                else:
                    dc_first(bits, self.books[book >> 4], c, rows, al)
            elif ah:
                ac_refine(bits, self.books[0x10 | book & 15], c, rows, ss, se, al)
            else:
                ac_first(bits, self.books[0x10 | book & 15], c, rows, ss, se, al)
        return end

    def _interleaved(self, bits: Bits, orders: list, low: int, high: int, ah: int, al: int) -> None:
        before = [0] * len(orders)
        for u in range(low, high):
            for i, (p, book, rows, _) in enumerate(orders):
                for row in rows[u]:
                    if ah:
                        p["c"][row, 0] |= bits.take(1) << al
                    else:
                        before[i] += bits.signed(bits.symbol(self.books[book >> 4]))
                        p["c"][row, 0] = before[i] << al

    @property
    def coefficients(self) -> list[np.ndarray]:
        return [p["c"] for p in self.parts.values()]

    def rgb(self) -> np.ndarray:
        """The (height, width, 3) samples: dequantised, inverse-transformed, chroma at full size."""
        planes = []
        for p in self.parts.values():
            samples = (p["c"] * self.tables[p["t"]]).astype(np.float32) @ BASIS
            plane = samples.reshape(p["high"], p["wide"], 8, 8).swapaxes(1, 2).reshape(p["high"] * 8, p["wide"] * 8) + 128
            plane = np.clip(np.rint(plane), 0, 255)
            plane = plane.repeat(self.vmax // p["v"], axis=0).repeat(self.hmax // p["h"], axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) < 3:
            return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        full = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(full), 0, 255).astype(np.uint8)


def images(data: bytes) -> Iterator[Image]:
    """The images of a stored value, one after the other."""
    at = 0
    while at < len(data):
        try:
            image = Image(data, at)
        except (IndexError, KeyError, struct.error) as e:
            raise ValueError(f"a damaged image at byte {at}") from e
        at = image.end
        yield image


def decode(data: bytes) -> np.ndarray:
    return Image(data).rgb()


def _marker(m: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, m, len(body) + 2) + body


def _coded(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.r_[bits, np.ones(pad, np.uint8)] if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


#: Sizes 8 to 0 (to 1 for AC) in codes of 1 to 9 bits: with its extra bits each takes 9.
DC_BOOK = bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)])
AC_BOOK = bytes([0x10, *[1] * 8, *[0] * 8, *range(8, 0, -1)])
#: End-of-band runs for the refinement.
RUN_BOOK = bytes([0x11, 0, 0, 0, 15, *[0] * 12, *[r << 4 for r in range(15)]])
SCAN = {(c, *k): _marker(0xDA, bytes([1, c, *k])) for c in (1, 2, 3) for k in ((0x00, 0, 0, 0x01), (0x00, 1, 5, 0x01), (0x00, 6, 63, 0x01), (0x00, 0, 0, 0x10), (0x01, 1, 63, 0x10))}
HEAD = b"\xff\xd8" + _marker(0xDB, b"\x00" + b"\x01" * 64) + _marker(0xC4, DC_BOOK + AC_BOOK + RUN_BOOK)


def _dc_fields() -> np.ndarray:
    """The 9-bit field of each difference from -255 to 255."""
    out = []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out.append(((1 << 9 - s) - 2 if s else 0b111111110) << s | (d if d > 0 else d + (1 << s) - 1))
    return np.array(out, ">u2")


DC_FIELDS = _dc_fields()


def _nine(v: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(v, ">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 7:].ravel()


def store_blocks(payload: np.ndarray) -> bytes:
    """A colour image one row of blocks high, whose coefficients are 256 plus the bytes of (blocks, 64):
    luma, then both chroma components, the last of them filled up with zeros. A comment says how many
    blocks are payload."""
    n, units = len(payload), -(-len(payload) // 4)
    whole = np.concatenate([payload, np.zeros((4 * units - n, 64), np.uint8)]) if n % 4 else payload
    out = [HEAD, _marker(0xFE, struct.pack(">I", n)), _marker(0xC2, struct.pack(">BHHB", 8, 8, 16 * units, 3) + b"\x01\x21\x00\x02\x11\x00\x03\x11\x00")]
    late = []
    for c, part in ((1, whole[: 2 * units]), (2, whole[2 * units : 3 * units]), (3, whole[3 * units :])):
        high, low, k = (part >> 1).astype(np.int16) + 128, part & 1, len(part)
        r = k.bit_length() - 1
        run = np.array([int(x) for x in f"{r:04b}" + (f"{k - (1 << r):0{r}b}" if r else "")], np.uint8)
        out += [
            SCAN[c, 0, 0, 0, 1], _coded(_nine(DC_FIELDS[np.diff(high[:, 0], prepend=0) + 255])),
            SCAN[c, 0, 1, 5, 1], _coded(_nine(high[:, 1:6])), SCAN[c, 0, 6, 63, 1], _coded(_nine(high[:, 6:])),
        ]
        late += [SCAN[c, 0, 0, 0, 16], _coded(low[:, 0]), SCAN[c, 1, 1, 63, 16], _coded(np.r_[run, low[:, 1:].ravel()])]
    return b"".join((*out, *late, b"\xff\xd9"))


def store(data: bytes) -> bytes:
    """Images that hold ``data``, which must be a positive multiple of 64 bytes long."""
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 64)
    return b"".join(store_blocks(blocks[i : i + BLOCKS]) for i in range(0, len(blocks), BLOCKS))


def payload(image: Image) -> bytes:
    """The bytes that ``store_blocks`` put into an image."""
    n = struct.unpack(">I", image.comment)[0]
    return (np.concatenate(image.coefficients)[:n] - 256).astype(np.uint8).tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))


def to_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text (null: empty) stored as progressive JPEG bytes, one
    row for each row. Texts above BLOCKS blocks become several images in one value."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                held = [padded(t) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "n_bytes": [n for n, _ in held], "media": [store(d) for _, d in held]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(of, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def tensors(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, image, height, width, rgb): the full-resolution tensor of each image, row-major bytes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, data in zip(pdf["id"], pdf["media"], strict=True):
                for k, image in enumerate(images(data)):
                    t = image.rgb()
                    yield pd.DataFrame({"id": [i], "image": [k], "height": [t.shape[0]], "width": [t.shape[1]], "rgb": [t.tobytes()]})

    rows = media.select(F.col(id_col).alias("id"), "media").filter("media is not null")
    return rows.mapInPandas(of, "id long, image int, height int, width int, rgb binary").withColumnRenamed("id", id_col)


def describe(data: bytes) -> tuple[int, str, int, int, str, str]:
    """What reading a stored value back gives: payload bytes, SHA-256 and CRC of the last 64, the
    value's own bytes and SHA-256, and a feature of its samples."""
    sha, n, tail, crc, total, square, wide = hashlib.sha256(), 0, b"", 0, 0, 0, 0
    for image in images(data):
        part = payload(image)
        sha.update(part)
        n, tail = n + len(part), part[-64:]
        rgb = image.rgb()
        grey = rgb.astype(np.int64)
        crc, wide = zlib.crc32(rgb.tobytes(), crc), wide + image.width
        total, square = total + int(grey.sum()), square + int((grey * grey).sum())
    mean = total / (24 * wide)
    return n, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), f"8x{wide}x3 mean={mean:.4f} var={square / (24 * wide) - mean * mean:.4f} crc={crc:08x}"


def read_back(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): each
    value of ``to_media`` read back. A null value gives nulls; one that is damaged ends the job with an
    error that says where, as a wrong payload would be worse."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for pdf in batches:
            out = pd.DataFrame([(None,) * 6 if d is None else describe(d) for d in pdf["media"]], columns=names, index=pdf.index)
            out[names[0]], out[names[2]], out[names[3]] = (out[names[i]].astype("Int64") for i in (0, 2, 3))
            yield pd.concat([pdf[["id", "n_bytes"]], out], axis=1)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.withColumnRenamed(id_col, "id").mapInPandas(of, schema).withColumnRenamed("id", id_col)
