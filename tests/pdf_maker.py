"""Makes PDF files for the tests: plain and compressed tables, object streams, revisions and filters."""

from __future__ import annotations

import base64
import zlib


def predicted(data: bytes, columns: int, how: int) -> bytes:
    """PNG rows, each by one predictor."""
    data = data.ljust(-(-len(data) // columns) * columns, b" ")
    out, above = b"", bytes(columns)
    for lo in range(0, len(data), columns):
        row, new = data[lo : lo + columns], []
        for k in range(columns):
            left, up, corner = (row[k - 1], above[k], above[k - 1]) if k else (0, above[k], 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            new.append((row[k] - (0, left, up, (left + up) // 2, paeth)[how]) & 255)
        out += bytes([how, *new])
        above = row
    return out


def run_lengths(data: bytes) -> bytes:
    out = b""
    for lo in range(0, len(data), 100):
        part = data[lo : lo + 100]
        out += bytes([len(part) - 1]) + part if len(set(part)) > 1 or len(part) < 2 else bytes([257 - len(part)]) + part[:1]
    return out + b"\x80"


def lzw(data: bytes) -> bytes:
    """Codes of nine bits and more, with the table cleared before it is full."""
    codes, table, now = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    width, size = 9, 258
    for c in data:
        if now + bytes([c]) in table:
            now += bytes([c])
            continue
        codes.append((table[now], width))
        table[now + bytes([c])] = size
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
        now = bytes([c])
        if size >= 4000:
            codes.append((table[now], width))
            codes.append((256, width))
            table, size, width, now = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if now:
        codes.append((table[now], width))
        width += size + 2 > 1 << width and width < 12
    codes.append((257, width))
    bits = "".join(f"{v:0{w}b}" for v, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


ENCODERS = {
    "": lambda d: d,
    "/Filter /FlateDecode": zlib.compress,
    "/Filter /Fl": lambda d: zlib.compress(d)[2:-4],
    "/Filter [/ASCII85Decode]": lambda d: base64.a85encode(d) + b"~>",
    "/Filter [/ASCIIHexDecode /FlateDecode]": lambda d: zlib.compress(d).hex().encode() + b">",
    "/Filter /RunLengthDecode": run_lengths,
    "/Filter [/LZWDecode]": lzw,
    "/Filter [/ASCII85Decode /LZWDecode]": lambda d: base64.a85encode(lzw(d)) + b"~>",
}
for _how in range(5):
    ENCODERS[f"/Filter [/FlateDecode] /DecodeParms [<< /Predictor {10 + _how} /Columns 20 >>]"] = lambda d, how=_how: zlib.compress(predicted(d, 20, how))


def stream(data: bytes, filters: str = "", more: str = "", length: str | None = None) -> bytes:
    body = ENCODERS[filters](data)
    return f"<< /Length {len(body) if length is None else length} {filters} {more} >>\nstream\n".encode() + body + b"\nendstream"


def plain(objects: dict[int, bytes], trailer: str = "", earlier: bytes = b"", prev: int | None = None) -> bytes:
    """A file with a plain table; with ``earlier`` a later revision of it."""
    out, rows = earlier or b"%PDF-1.4\n", []
    for num, body in objects.items():
        rows.append((num, len(out)))
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    at = len(out)
    table = b"xref\n" + (b"" if earlier else b"0 1\n0000000000 65535 f \n") + b"".join(b"%d 1\n%010d 00000 n \n" % r for r in rows)
    more = f"/Prev {prev}" if prev is not None else ""
    return out + table + f"trailer\n<< /Size {max(objects) + 1} {trailer} {more} >>\nstartxref\n{at}\n%%EOF\n".encode()


def packed(objects: dict[int, bytes], inside: dict[int, bytes], trailer: str = "", predictor: bool = True) -> bytes:
    """A file with a compressed table, and ``inside`` in an object stream."""
    out, rows, box, own = b"%PDF-1.5\n", {}, max([*objects, *inside]) + 1, max([*objects, *inside]) + 2
    heads, bodies = [], b""
    for num, body in inside.items():
        heads.append(f"{num} {len(bodies)}")
        bodies += body + b" "
    first = (" ".join(heads) + " ").encode()
    every = dict(objects) | {box: stream(first + bodies, "/Filter /FlateDecode", f"/Type /ObjStm /N {len(inside)} /First {len(first)}")}
    for num, body in every.items():
        rows[num] = (1, len(out), 0)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    rows |= {num: (2, box, k) for k, num in enumerate(inside)} | {0: (0, 0, 255), own: (1, len(out), 0)}
    table = b"".join(bytes([a]) + b.to_bytes(4, "big") + bytes([c]) for a, b, c in (rows.get(n, (0, 0, 0)) for n in range(own + 1)))
    filters = "/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >>" if predictor else "/Filter /FlateDecode"
    body = zlib.compress(predicted(table, 6, 2)) if predictor else zlib.compress(table)
    at = len(out)
    return out + f"{own} 0 obj\n<< /Type /XRef /Size {own + 1} /W [1 4 1] {filters} /Length {len(body)} {trailer} >>\nstream\n".encode() + body + f"\nendstream\nendobj\nstartxref\n{at}\n%%EOF\n".encode()


def literal(text: str) -> str:
    return "(" + "".join("\\" + c if c in "\\()" else c for c in text) + ")"


def document(pages: list[list[tuple[str, float, float]]], outline: list[tuple[str, str]] = (), names: dict[str, int] | None = None, compressed: bool = False, filters: str = "/Filter /FlateDecode") -> bytes:
    """A file of pages of (text, x, y); ``outline`` is (title, destination in the format) with {n} for page n's reference."""
    n = len(pages)
    content = lambda items: ("BT /F1 12 Tf " + " ".join(f"1 0 0 1 {x} {y} Tm {literal(t)} Tj" for t, x, y in items) + " ET").encode("cp1252")
    streams = {10 + k: stream(content(items), filters) for k, items in enumerate(pages)}
    ref = lambda k: f"{100 + k} 0 R"
    values = {
        1: f"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R /Names << /Dests 4 0 R >> >>",
        2: f"<< /Type /Pages /Count {n} /Kids [{' '.join(ref(k) for k in range(n))}] /Resources << /Font << /F1 3 0 R >> >> >>",
        3: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        4: "<< /Names [" + " ".join(f"({k}) [{ref(v)} /XYZ 0 0 0]" for k, v in (names or {}).items()) + "] >>",
        5: "<< /Type /Outlines " + ("/First 1000 0 R" if outline else "") + " >>",
    }
    values |= {100 + k: f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents {10 + k} 0 R >>" for k in range(n)}
    for k, (title, dest) in enumerate(outline):
        where = dest.format(*[ref(p) for p in range(n)])
        values[1000 + k] = f"<< /Title {literal(title)} /Parent 5 0 R {where} {f'/Next {1001 + k} 0 R' if k + 1 < len(outline) else ''} >>"
    inside = {k: v.encode("latin-1") for k, v in values.items()}
    return packed(streams, inside, "/Root 1 0 R") if compressed else plain({**inside, **streams}, "/Root 1 0 R")
