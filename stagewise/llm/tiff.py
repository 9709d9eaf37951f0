"""TIFF: image directories, strips and tiles, PackBits, LZW and deflate, predictors 1 to 3."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise import scratch

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Letters of numpy's kinds by sample format: unsigned, signed, floating.
FORMATS = {1: "u", 2: "i", 3: "f"}
#: How many bytes a compressed byte can give at most.
RATIO = {NONE: 1, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64, LZW: 4096}
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: What a damaged file can make the reader raise; nothing else stands for one.
DAMAGE = (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError, OverflowError)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    format: int
    pixels: np.ndarray  # height x width x samples


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and data[j : j + 3] != data[j : j + 1] * 3:
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears, 257 ends; widths change one code early."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    width, last, acc, have, made = 9, None, 0, 0, 0
    for byte in data:
        if most is not None and made >= most:
            break
        acc, have = (acc << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code, acc = acc >> have, acc & ((1 << have) - 1)
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        if last is None:
            item = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            item = table[code] if code < len(table) else last + last[:1]
            table.append(last + item[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(item)
        made += len(item)
        last = item
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, have, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal acc, have
        acc, have = (acc << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(acc >> have)
            acc &= (1 << have) - 1

    first = {bytes((i,)): i for i in range(256)}
    table, size, now = dict(first), 258, b""
    put(256)
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        put(table[now])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = dict(first), 258, 9
        elif size >= 1 << width:
            width += 1
        now = data[i : i + 1]
    if now:
        put(table[now])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append((acc << (8 - have)) & 255)
    return bytes(out)


def unpack(data: bytes, compression: int, most: int | None = None) -> bytes:
    """The decoded bytes; with ``most``, decoding ends once there are as many."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data) if most is None else zlib.decompressobj().decompress(data, max(most, 1))
    if compression == PACKBITS:
        return packbits_decode(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    raise ValueError(f"compression {compression} is not supported")


def pack(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode}[compression](data)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each directory in turn; a chain that returns to a directory is an error."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind not in KINDS:
                continue
            size = struct.calcsize(order + KINDS[kind]) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            # values beyond the file's end leave the tag out before anything is made for them
            if place + size <= len(data):
                tags[tag] = struct.unpack_from(order + KINDS[kind] * count, data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def samples(raw: bytes, rows: int, wide: int, n: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """rows x wide x n samples of a decoded strip or tile; samples below 8 bits are unpacked, rows start at a byte."""
    if bits < 8:
        line = -(-wide * n * bits // 8)
        packed = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line, 1)
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        return ((packed >> shifts) & ((1 << bits) - 1)).reshape(rows, -1)[:, : wide * n].reshape(rows, wide, n)
    size = kind.itemsize
    if predictor == 3:
        # bytes are differences at a distance of n; the row's most significant bytes come first
        planes = np.frombuffer(raw, np.uint8, rows * wide * n * size).reshape(rows, wide * size, n)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, wide * n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, wide, n)
    block = np.frombuffer(raw, kind, rows * wide * n).reshape(rows, wide, n)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


def read_page(data: bytes, order: str, tags: dict[int, tuple], most_bytes: int = 1 << 28) -> Page:
    """One directory's samples: 1, 2, 4, 8, 16, 32 or 64 bits, chunky or in planes, strips or tiles.

    Sizes are held against what the file's strips can hold and against ``most_bytes`` of decoded
    samples before memory is taken; a page beyond either is an error.
    """

    def one(tag: int, default: int | None = None) -> int:
        value = tags.get(tag, (default,))[0]
        if not isinstance(value, int) or value < 0:
            raise ValueError(f"tag {tag} is not a number")
        return value

    width, height, n = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    how, predictor, planar, form = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    bits = one(BITS, 1)
    kinds = FORMATS.get(form, "?")
    if any(b != bits for b in tags.get(BITS, (bits,))) or bits not in ((32, 64) if kinds == "f" else (1, 2, 4, 8, 16, 32, 64) if kinds == "u" else (8, 16, 32, 64)):
        raise ValueError(f"samples of {tags.get(BITS, (1,))[:8]} bits, format {form}: not supported")
    if how not in RATIO or planar not in (1, 2) or predictor not in (1, 2, 3) or (predictor == 2 and (bits < 8 or kinds == "f")) or (predictor == 3 and kinds != "f"):
        raise ValueError(f"compression {how}, predictor {predictor}, planar {planar} of {bits} bits: not supported")
    if not width or not height or not n:
        raise ValueError("a page without samples")
    kind = np.dtype(np.uint8) if bits <= 8 and kinds == "u" else np.dtype(f"{order}{kinds}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    wide = one(TILE_WIDTH) if tiled else width
    high = one(TILE_LENGTH) if tiled else min(one(ROWS_PER_STRIP, height), height)
    if not wide or not high:
        raise ValueError("strips or tiles without samples")
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    across, down, layers = -(-width // wide), -(-height // high), n if planar == 2 else 1
    deep = n // layers
    if len(offsets) != len(counts) or len(offsets) < across * down * layers:
        raise ValueError("too few strips or tiles for the page")
    stored = sum(min(c, len(data)) for c in counts)
    if max(width * height * n * kind.itemsize, wide * high * deep * kind.itemsize) > most_bytes:
        raise ValueError(f"{width} x {height} x {n} samples are more than {most_bytes} bytes")
    if width * height * n * bits > stored * 8 * RATIO[how]:
        raise ValueError("the strips are too short for the page's size")
    pixels = np.zeros((height, width, n), kind.newbyteorder("="))
    flipped = one(FILL_ORDER, 1) == 2
    for k in range(across * down * layers):
        layer, place = divmod(k, across * down)
        y, x = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - y)
        part = bytes(data[offsets[k] : offsets[k] + counts[k]])
        need = rows * -(-wide * deep * bits // 8)
        raw = unpack(part.translate(REVERSED) if flipped else part, how, need)
        block = samples(raw, rows, wide, deep, bits, kind, predictor)[: height - y, : width - x]
        pixels[y : y + block.shape[0], x : x + block.shape[1], layer * deep : (layer + 1) * deep] = block
    return Page(width, height, n, bits, how, predictor, tiled, form, pixels)


def read_pages(data: bytes, most_bytes: int = 1 << 28) -> Iterator[Page]:
    """Each page with its samples; one that can't be read is an error."""
    for order, tags in directories(data):
        yield read_page(data, order, tags, most_bytes)


def differences(part: np.ndarray, predictor: int, order: str) -> bytes:
    """A strip's or tile's bytes after the predictor."""
    if predictor == 2:
        part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
    if predictor != 3:
        return part.astype(part.dtype.newbyteorder(order)).tobytes()
    rows, wide, n = part.shape
    raw = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, wide * n, -1)
    planes = np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(rows, -1, n)
    return np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).tobytes()


def write_pages(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 256,
    tile: tuple[int, int] | None = None, order: str = "<", planar: int = 1, depth: int | None = None,
) -> bytes:
    """A TIFF of the given height x width (x samples) arrays; ``tile`` is (rows, columns).

    ``planar`` 2 stores each sample's plane by itself; ``depth`` 1, 2 or 4 packs 8-bit arrays of such values.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, n = page.shape
        bits = depth or page.dtype.itemsize * 8
        form = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        high, wide = tile or (strip_rows, width)
        blocks = []
        for layer in [page] if planar == 1 else [page[:, :, k : k + 1] for k in range(n)]:
            for y in range(0, height, high):
                for x in range(0, width, wide):
                    part = layer[y : y + high, x : x + wide]
                    if tile:
                        part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                    if depth:
                        flat = part.reshape(part.shape[0], -1)
                        digits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1
                        data = np.packbits(digits.reshape(part.shape[0], -1), axis=1).tobytes()
                    else:
                        data = differences(part, predictor, order)
                    data = pack(data, compression)
                    blocks.append((len(out), len(data)))
                    out += data
        offsets, counts = [b[0] for b in blocks], [b[1] for b in blocks]
        tags = {
            WIDTH: ("I", [width]), LENGTH: ("I", [height]), BITS: ("H", [bits] * n), COMPRESSION: ("H", [compression]),
            PHOTOMETRIC: ("H", [1]), SAMPLES: ("H", [n]), PLANAR: ("H", [planar]), PREDICTOR: ("H", [predictor]),
        }
        if form != 1:
            tags[SAMPLE_FORMAT] = ("H", [form] * n)
        if tile:
            tags |= {TILE_WIDTH: ("I", [wide]), TILE_LENGTH: ("I", [high]), TILE_OFFSETS: ("I", offsets), TILE_COUNTS: ("I", counts)}
        else:
            tags |= {STRIP_OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [high]), STRIP_COUNTS: ("I", counts)}
        entries = bytearray()
        for tag, (form, values) in sorted(tags.items()):
            body = struct.pack(order + form * len(values), *values)
            if len(body) > 4:
                place = len(out)
                out += body
                body = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, 3 if form == "H" else 4, len(values)) + body.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


PAGE_COLUMNS = (
    "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean,"
    " format int, pixels binary, error string"
)


def tiff_pages(df: DataFrame, key: str = "doc_id", media: str = "media", most_bytes: int = 1 << 28) -> DataFrame:
    """One row per page: the key, PAGE_COLUMNS; samples in rows from the top, little-endian, those below 8 bits a byte each.

    A page that can't be read (damaged, of another kind, of more than ``most_bytes`` decoded bytes)
    gives a row with its number and the reason in ``error``, and the walk goes on with the next
    directory. A file that isn't a TIFF or whose chain of directories breaks gives a row with page -1
    and the reason, after the pages before the fault. A null media value gives no row, an empty table
    none; repeated rows give repeated pages. The key may have any name but those of PAGE_COLUMNS.
    """
    scratch.not_among(key, [c.split()[0] for c in PAGE_COLUMNS.split(", ")])
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        def row(k, page, *values, error=None):
            return pa.RecordBatch.from_pylist([dict(zip(names, (k, page, *(values or [None] * (len(names) - 3)), error), strict=True))], schema)

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                data = value.as_buffer().to_pybytes()
                try:
                    for page, (order, tags) in enumerate(directories(data)):
                        try:
                            p = read_page(data, order, tags, most_bytes)
                            raw = p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                            yield row(k, page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.format, raw)
                        except DAMAGE as e:
                            yield row(k, page, error=str(e) or type(e).__name__)
                except DAMAGE as e:
                    yield row(k, -1, error=str(e) or type(e).__name__)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"`{key}` {kind}, {PAGE_COLUMNS}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    names = schema.names
    return df.select(F.col(key), F.col(media).cast("binary")).mapInArrow(run, ddl)


def sample_features(x: np.ndarray) -> str:
    """Size, mean, deviation, entropy and mean steps across and down of 8-bit samples (rows x 64)."""
    counts = np.bincount(x.ravel(), minlength=256)
    p = counts[counts > 0] / x.size
    v = x.astype(np.int16)
    across = np.abs(np.diff(v, axis=1)).mean() if x.shape[1] > 1 else 0.0
    down = np.abs(np.diff(v, axis=0)).mean() if x.shape[0] > 1 else 0.0
    return (
        f"w={x.shape[1]};h={x.shape[0]};mean={x.mean():.4f};std={x.std():.4f};"
        f"entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};dx={across:.4f};dy={down:.4f}"
    )


def stored_texts(
    df: DataFrame, key: str = "doc_id", text: str = "text", page_rows: int = 16384, compression: int = DEFLATE,
    predictor: int = 2,
) -> DataFrame:
    """Each text as a TIFF of 64 columns, read back by :func:`read_pages`: digests and features of what was read.

    The text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, are the samples; a long
    text takes several pages of ``page_rows``. A null text counts as empty; repeated rows get a result
    each, an empty table none; equal texts have equal values. Columns: key, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_pages.
    """
    scratch.not_among(key, ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"])
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(8)]
            for value in batch.column(1):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
                image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
                media = write_pages([image[i : i + page_rows] for i in range(0, len(image), page_rows)], compression, predictor)
                pages = [p.pixels[:, :, 0] for p in read_pages(media)]
                back = np.concatenate(pages) if len(pages) > 1 else pages[0]
                got = back.tobytes()
                for col, x in zip(cols, (
                    len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media),
                    hashlib.sha256(media).hexdigest(), sample_features(back), len(pages),
                ), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    long, text_type = pa.int64(), pa.string()
    types = [long, long, text_type, long, long, text_type, text_type, long]
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
    ddl = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"
    return df.select(F.col(key), F.col(text).cast("string").cast("binary")).mapInArrow(run, ddl)
