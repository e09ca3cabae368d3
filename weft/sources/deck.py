"""Slides as a presentation file (Office Open XML), written with the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Presentations (some 10 KB each) that stand in a task's memory at once.
AT_ONCE = 200
_NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
_TREE = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
_MAP = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'


def _box(number: int, name: str, y: int, height: int, paragraphs: list[tuple[str, int]], size: int) -> str:
    text = "".join(f'<a:p><a:pPr lvl="{min(level, 8)}"/><a:r><a:rPr sz="{size}"/><a:t>{escape(t)}</a:t></a:r></a:p>' for t, level in paragraphs) or "<a:p/>"
    place = f'<a:xfrm><a:off x="457200" y="{y}"/><a:ext cx="8229600" cy="{height}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom>'
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="{name}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr>{place}</p:spPr><p:txBody><a:bodyPr wrap="square"/><a:lstStyle/>{text}</p:txBody></p:sp>'


def _rels(items: list[tuple[str, str, str]]) -> str:
    return f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_REL}{kind}" Target="{to}"/>' for i, kind, to in items) + "</Relationships>"


def _theme() -> str:
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in zip("dk1 lt1 dk2 lt2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split(), "000000 FFFFFF 333333 EEEEEE 4472C4 ED7D31 A5A5A5 FFC000 5B9BD5 70AD47 0563C1 954F72".split(), strict=True))
    font = '<a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill, line, effect = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>', "<a:effectStyle><a:effectLst/></a:effectStyle>"
    return f'{_HEAD}<a:theme {_NS} name="t"><a:themeElements><a:clrScheme name="t">{colours}</a:clrScheme><a:fontScheme name="t"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="t"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'


def presentation(slides: list[dict]) -> bytes:
    """The file of slides: type, title, subtitle and items [(type, text, level)]."""
    out, n = io.BytesIO(), len(slides)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = "application/vnd.openxmlformats-officedocument.presentationml."
        kinds = [("/ppt/presentation.xml", part + "presentation.main+xml"), ("/ppt/slideMasters/slideMaster1.xml", part + "slideMaster+xml"), ("/ppt/slideLayouts/slideLayout1.xml", part + "slideLayout+xml"), ("/ppt/theme/theme1.xml", "application/vnd.openxmlformats-officedocument.theme+xml")]
        kinds += [(f"/ppt/slides/slide{i + 1}.xml", part + "slide+xml") for i in range(n)]
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="{p}" ContentType="{c}"/>' for p, c in kinds) + "</Types>")
        z.writestr("_rels/.rels", _rels([("rId1", "officeDocument", "ppt/presentation.xml")]))
        z.writestr("ppt/_rels/presentation.xml.rels", _rels([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), *((f"rId{i + 2}", "slide", f"slides/slide{i + 1}.xml") for i in range(n))]))
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 2}"/>' for i in range(n))
        z.writestr("ppt/presentation.xml", f'{_HEAD}<p:presentation {_NS}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>')
        z.writestr("ppt/slideMasters/slideMaster1.xml", f'{_HEAD}<p:sldMaster {_NS}><p:cSld><p:spTree>{_TREE}</p:spTree></p:cSld>{_MAP}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>')
        z.writestr("ppt/slideMasters/_rels/slideMaster1.xml.rels", _rels([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "theme", "../theme/theme1.xml")]))
        z.writestr("ppt/slideLayouts/slideLayout1.xml", f'{_HEAD}<p:sldLayout {_NS} type="blank"><p:cSld name="blank"><p:spTree>{_TREE}</p:spTree></p:cSld></p:sldLayout>')
        z.writestr("ppt/slideLayouts/_rels/slideLayout1.xml.rels", _rels([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")]))
        z.writestr("ppt/theme/theme1.xml", _theme())
        for i, s in enumerate(slides):
            big = s["type"] != "content"
            boxes = _box(2, "title", 2_000_000 if big else 300_000, 1_000_000, [(s["title"], 0)], 4000 if big else 2800)
            body = ([(s["subtitle"], 0)] if s.get("subtitle") else []) + [(t or "", level or 0) for _, t, level in s["items"]]
            boxes += _box(3, "body", 3_200_000 if big else 1_400_000, 4_800_000 if not big else 2_800_000, body, 1800)
            z.writestr(f"ppt/slides/slide{i + 1}.xml", f"{_HEAD}<p:sld {_NS}><p:cSld><p:spTree>{_TREE}{boxes}</p:spTree></p:cSld></p:sld>")
            z.writestr(f"ppt/slides/_rels/slide{i + 1}.xml.rels", _rels([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")]))
    return out.getvalue()


def grouped(rows: list) -> list[dict]:
    """Slides from rows (slide_no, item_no, slide_type, title, subtitle, type, text, level)."""
    slides: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        s = slides.setdefault(r[0], {"type": r[2], "title": r[3] or "", "subtitle": r[4] or "", "items": []})
        if r[1] is not None:
            s["items"].append((r[5], r[6], r[7]))
    return list(slides.values())


def decks(slide_rows: DataFrame, key: str) -> DataFrame:
    """(key, deck, size): one presentation file for each document's slides."""
    from weft.functions.markdown import SLIDES

    names = [c.split()[0] for c in SLIDES.split(", ")]
    one = slide_rows.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("rows"))
    kinds = dict(slide_rows.dtypes)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.iloc[at : at + AT_ONCE]
                made = [presentation(grouped([tuple(r[n] for n in names) for r in rows])) for rows in part["rows"]]
                yield part[[key]].assign(deck=made, size=[len(m) for m in made])

    return one.mapInPandas(run, f"{key} {kinds[key]}, deck binary, size long")


def slide_counts(slide_rows: DataFrame, key: str) -> DataFrame:
    """Slides of each type."""
    one = slide_rows.select(key, "slide_no", "slide_type").distinct()
    return one.groupBy(key).agg(F.count("*").alias("slides"), *(F.count_if(F.col("slide_type") == t).alias(t) for t in ("title", "section", "content")))
