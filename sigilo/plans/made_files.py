"""Files for the registered queries, made from the rows of the driver's tables in several forms of the format."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.pdf_objects import Name, Ref, written

#: Forms by number: filters of the page streams and how they are coded; the last form's filter is unknown to any reader.
FORMS = [
    ([], lambda d: d),
    (["FlateDecode"], zlib.compress),
    (["ASCII85Decode"], lambda d: base64.a85encode(d) + b"~>"),
    (["ASCIIHexDecode", "FlateDecode"], lambda d: zlib.compress(d).hex().encode() + b">"),
    (["Unheard"], lambda d: d),
]


def stream(own: dict, data: bytes) -> bytes:
    return written(own | {"Length": len(data)}) + b"\nstream\n" + data + b"\nendstream"


def shown(text: str, y: int) -> bytes:
    body = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"BT /F1 9 Tf 1 0 0 1 40 %d Tm (%s) Tj ET" % (y, body)


def made(form: int, texts: list[str], outline: list[tuple[str, int | None]], packed: bool) -> bytes:
    """A file of one page a text, with an outline of (title, page) whose odd entries go by name; ``packed`` puts all but streams into one object stream."""
    filters, coded = FORMS[form]
    n, page = len(texts), lambda k: Ref(100_000 + k, 0)
    objects: dict[int, dict | list] = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Outlines": Ref(4, 0), "Names": {"Dests": Ref(5, 0)}},
        2: {"Type": Name("Pages"), "Count": n, "Kids": [page(k) for k in range(n)], "Resources": {"Font": {"F1": Ref(3, 0)}}},
        3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")},
        4: {"Type": Name("Outlines")} | ({"First": Ref(200_000, 0)} if outline else {}),
        5: {"Names": [x for k in range(n) for x in (b"p%d" % k, [page(k), Name("Fit")])]},
    }
    objects |= {100_000 + k: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(1000 + k, 0)} for k in range(n)}
    for k, (title, to) in enumerate(outline):
        own = {"Title": b"\xfe\xff" + title.encode("utf-16-be"), "Parent": Ref(4, 0)}
        own |= {} if to is None else {"Dest": b"p%d" % to} if k % 2 else {"Dest": [page(to), Name("Fit")]}
        objects[200_000 + k] = own | ({"Next": Ref(200_001 + k, 0)} if k + 1 < len(outline) else {})
    named = {"Filter": [Name(f) for f in filters]} if filters else {}
    bodies = {1000 + k: stream(named, coded(shown(t, 700))) for k, t in enumerate(texts)}
    if packed:
        inner = {k: written(v) for k, v in objects.items()}
        heads, at = [], 0
        for k, v in inner.items():
            heads.append(b"%d %d " % (k, at))
            at += len(v) + 1
        first = b"".join(heads)
        data = zlib.compress(first + b"".join(v + b" " for v in inner.values()))
        bodies[9] = stream({"Type": Name("ObjStm"), "N": len(inner), "First": len(first), "Filter": Name("FlateDecode")}, data)
    else:
        bodies |= {k: written(v) for k, v in objects.items()}
    out, at, places = [b"%PDF-1.5\n"], 9, {}
    for num, body in sorted(bodies.items()):
        places[num] = at
        out.append(b"%d 0 obj\n%s\nendobj\n" % (num, body))
        at += len(out[-1])
    if packed:
        rows = [(num, (1).to_bytes(1, "big") + p.to_bytes(4, "big") + b"\0\0\0\0") for num, p in places.items()]
        rows += [(num, b"\2" + (9).to_bytes(4, "big") + k.to_bytes(4, "big")) for k, num in enumerate(objects)]
        own = {"Type": Name("XRef"), "Size": 300_000, "W": [1, 4, 4], "Index": [x for num, _ in rows for x in (num, 1)], "Root": Ref(1, 0), "Filter": Name("FlateDecode")}
        return b"".join([*out, b"8 0 obj\n", stream(own, zlib.compress(b"".join(r for _, r in rows))), b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at])
    table = b"".join(b"%d 1\n%010d 00000 n \n" % (num, p) for num, p in places.items())
    return b"".join([*out, b"xref\n0 1\n0000000000 65535 f \n", table, b"trailer\n", written({"Size": 300_000, "Root": Ref(1, 0)}), b"\nstartxref\n%d\n%%%%EOF\n" % at])


def made_file(number: Column, texts: Column, outline: Column | None = None, forms: int = len(FORMS) - 1) -> Column:
    """A file of the texts (array<string>) and the outline (array<struct<title, page>>); its form goes by the number."""

    @once
    @F.pandas_udf("binary")
    def build(numbers: pd.Series, texts: pd.Series, outlines: pd.Series) -> pd.Series:
        out = [
            made(int(k) % forms, list(own), [(o["title"], None if pd.isna(o["page"]) else int(o["page"])) for o in top], int(k) // forms % 2 == 1)
            for k, own, top in zip(numbers, texts, outlines, strict=True)
        ]
        return pd.Series(out, dtype=object)

    return build(number, texts, F.array().cast("array<struct<title:string,page:bigint>>") if outline is None else outline)
