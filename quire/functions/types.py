"""Type identifiers, file extensions, MIME types and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.strings import c

INLINE = "com.apple.notes.inlinetextattachment."
# Classes of type identifiers.
INLINE_KINDS = {"hashtag": "inline_hashtag", "mention": "inline_mention", "link": "inline_link", "calculateresult": "inline_calc_result", "calculategraphexpression": "inline_calc_graph"}
CLASSES = {
    "gallery": ["com.apple.notes.gallery"],
    "table": ["com.apple.notes.table"],
    "sketch": ["com.apple.notes.sketch"],
    "drawing": ["com.apple.drawing.2", "com.apple.drawing", "com.apple.paper"],
    "scan": ["com.apple.paper.doc.scan", "com.apple.paper.doc.pdf"],
    "url": ["public.url"],
    "pdf": ["com.adobe.pdf"],
    "vcard": ["public.vcard"],
    "calendar": ["com.apple.ical.ics"],
    "image": [
        "public.jpeg", "public.png", "public.tiff", "public.heic", "public.jpeg-2000", "public.svg-image", "public.xbitmap-image",
        "public.camera-raw-image", "public.fax", "com.compuserve.gif", "com.microsoft.bmp", "com.microsoft.ico",
        "com.adobe.photoshop-image", "com.adobe.illustrator.ai-image", "com.adobe.raw-image", "com.apple.icns",
        "com.apple.macpaint-image", "com.apple.pict", "com.apple.quicktime-image", "com.ilm.openexr-image",
        "com.kodak.flashpix.image", "com.sgi.sgi-image", "com.truevision.tga-image", "org.webmproject.webp",
    ],
    "video": [
        "public.mpeg-4", "public.mpeg", "public.avi", "public.mpeg-2-video", "public.mpeg-2-transport-stream", "public.mpeg-4-audio",
        "com.apple.quicktime-movie", "com.apple.m4v-video", "com.apple.protected-mpeg-4-video", "com.apple.protected-mpeg-4-audio",
    ],
    "audio": [
        "public.mp3", "public.aiff-audio", "public.midi-audio", "com.apple.m4a-audio", "com.microsoft.waveform-audio", "org.xiph.ogg-audio",
    ],
    "document": [
        "com.apple.iwork.numbers.sffnumbers", "com.apple.log", "com.apple.rtfd", "com.microsoft.word.doc", "com.microsoft.excel.xls",
        "com.microsoft.powerpoint.ppt", "com.netscape.javascript-source", "net.daringfireball.markdown", "net.openvpn.formats.ovpn",
        "org.idpf.epub-container", "org.oasis-open.opendocument.text", "org.openxmlformats.wordprocessingml.document",
    ],
}
# Types that are no files, extensions and MIME types, labels and icons.
NON_FILE = ("com.apple.notes.table", "com.apple.notes.inlinetextattachment", "com.apple.notes.inlinehashtagattachment", "com.apple.notes.inlinementionattachment", "public.url")
EXTENSIONS = {
    "public.jpeg": "jpg", "public.png": "png", "public.pdf": "pdf", "public.heic": "heic", "public.heif": "heif", "public.tiff": "tiff",
    "public.image": "jpg", "public.mpeg-4": "mp4", "public.mp3": "mp3", "public.mpeg-4-audio": "m4a", "public.plain-text": "txt",
    "public.text": "txt", "public.shell-script": "sh", "public.zip-archive": "zip", "com.apple.quicktime-movie": "mov",
    "com.apple.m4a-audio": "m4a", "com.apple.paper": "jpg", "com.apple.drawing": "jpg", "com.apple.drawing.2": "jpg",
    "com.apple.paper.doc.pdf": "pdf", "com.apple.paper.doc.scan": "pdf", "com.apple.notes.gallery": "jpg", "com.adobe.pdf": "pdf",
    "com.adobe.encapsulated-postscript": "eps", "com.compuserve.gif": "gif", "com.microsoft.word.doc": "doc",
    "org.openxmlformats.wordprocessingml.document": "docx", "com.microsoft.excel.xls": "xls",
    "org.openxmlformats.spreadsheetml.sheet": "xlsx", "com.microsoft.powerpoint.ppt": "ppt",
    "org.openxmlformats.presentationml.presentation": "pptx",
}
MIME_OF = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "heic": "image/heic", "heif": "image/heif", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "bmp": "image/bmp"}
EXT_OF = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/heic": "heic", "image/heif": "heif", "image/tiff": "tiff", "image/webp": "webp", "image/bmp": "bmp", "image/svg+xml": "svg", "application/pdf": "pdf"}
LABELS = {
    "public.movie": "Video", "com.apple.quicktime-movie": "QuickTime Movie", "public.mpeg-4": "MP4 Video", "public.mp3": "MP3 Audio",
    "public.text": "Text File", "public.plain-text": "Plain Text", "public.zip-archive": "ZIP Archive",
}
ICONS = {"video": ("video", "movie", "mp4", "mov"), "audio": ("audio", "music", "mp3"), "archive": ("zip", "archive"), "text": ("text", "txt")}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small literal map, null where the key is missing."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def classify_type(uti: Column | str) -> Column:
    """Class of a type identifier: inline kinds by prefix, exact names, then the ``public.`` and ``dyn.`` families."""
    u = c(uti)
    inline = F.coalesce(lookup(INLINE_KINDS, F.substring(u, len(INLINE) + 1, 1000)), F.lit("inline_unknown"))
    out = F.when(u.isNull() | (u == ""), "unknown").when(u.startswith(INLINE), inline)
    for name, members in CLASSES.items():
        out = out.when(u.isin(*members), name)
    return out.when(u.startswith("public.") | (u == "com.apple.macbinary-archive"), "public_generic").when(u.startswith("dyn."), "dynamic").otherwise("unknown")


def is_file(uti: Column | str) -> Column:
    """Whether an attachment is a file and not inline content."""
    u = c(uti)
    out = F.lit(False)
    for p in NON_FILE:
        out = out | u.startswith(p)
    return ~out


def file_extension(filename: Column | str, uti: Column | str) -> Column:
    """The file name's own extension if it has one of five characters at most, else that of the type, else null."""
    f = c(filename)
    own = F.when(f.contains("."), F.element_at(F.split(f, r"\."), -1))
    return F.coalesce(F.when(F.length(own) <= 5, own), lookup(EXTENSIONS, c(uti)))


def magic_ext(data: Column | str) -> Column:
    """Extension by leading bytes; null for unknown ones and for less than four bytes."""
    h = F.hex(F.substring(c(data), 1, 8))
    return F.when(
        F.length(c(data)) >= 4,
        F.when(h.startswith("FFD8FF"), "jpg").when(h.startswith("89504E47"), "png").when(h.startswith("25504446"), "pdf").when(h.startswith("47494638"), "gif")
        .when(F.substring(h, 9, 8) == "66747970", "heic"),
    )


def ext_chain(filename: Column | str, uti: Column | str, data: Column | str, default: str = "bin") -> Column:
    name = c(filename)
    own = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))
    return F.coalesce(F.when(F.length(own).between(1, 5), own), lookup(EXTENSIONS, c(uti)), magic_ext(data), F.lit(default))


def mime_of(ext: Column | str) -> Column:
    return F.coalesce(lookup(MIME_OF, F.lower(c(ext))), F.lit("application/octet-stream"))


def ext_of(mime: Column | str) -> Column:
    return lookup(EXT_OF, F.lower(c(mime)))


def type_label(uti: Column | str) -> Column:
    """Display name of a type: a known one, or its last component."""
    return F.coalesce(lookup(LABELS, c(uti)), F.concat(F.initcap(F.element_at(F.split(c(uti), r"\."), -1)), F.lit(" File")))


def type_icon(uti: Column | str) -> Column:
    u = c(uti)
    out = None
    for name, parts in ICONS.items():
        has = F.lit(False)
        for p in parts:
            has = has | u.contains(p)
        out = F.when(has, name) if out is None else out.when(has, name)
    return out.otherwise("file")


def generation(*columns: Column | str) -> Column:
    """First of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c(x), F.lit("")) for x in columns])


def image_size(data: Column | str) -> Column:
    """struct(width, height) from the header of a PNG or GIF; nulls for anything else."""
    d = c(data)
    num = lambda start, n: F.conv(F.hex(F.substring(d, start, n)), 16, 10).cast("int")
    swap = lambda start: F.conv(F.concat(F.hex(F.substring(d, start + 1, 1)), F.hex(F.substring(d, start, 1))), 16, 10).cast("int")
    png, gif = (F.hex(F.substring(d, 1, 4)) == "89504E47") & (F.length(d) >= 24), (F.hex(F.substring(d, 1, 3)) == "474946") & (F.length(d) >= 10)
    return F.struct(
        F.when(png, num(17, 4)).when(gif, swap(7)).alias("width"), F.when(png, num(21, 4)).when(gif, swap(9)).alias("height")
    )
