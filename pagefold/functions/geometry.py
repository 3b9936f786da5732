"""Column expressions for rectangles, matrices, colours and fonts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_matrix(a: Column, b: Column) -> Column:
    """Product of two matrices (a b c d e f) as arrays: a applied first."""
    return F.array(
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]
    )


def rect_width(r: Column) -> Column:
    return F.abs(r[2] - r[0])


def overlaps(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Whether two rectangles share some area; touching edges do not count."""
    return (ax1 < bx2) & (ax2 > bx1) & (ay1 < by2) & (ay2 > by1)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.array((1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k))


#: White point D65 and the matrix from XYZ to linear sRGB (fixed values).
WHITE = (0.950489, 1.0, 1.088840)
TO_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def lab_to_rgb(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """CIELAB to sRGB with its companding, clamped to 0 to 1."""
    y = (l + 16.0) / 116.0
    inverse = lambda t: F.when(t > 6 / 29, t * t * t).otherwise(3 * (6 / 29) * (6 / 29) * (t - 4 / 29))
    xyz = [w * inverse(t) for w, t in zip(WHITE, (a / 500.0 + y, y, y - b / 200.0), strict=True)]

    def compand(row) -> Column:
        linear = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(x * k for x, k in zip(xyz, row, strict=True))))
        return F.when(linear <= 0.0031308, 12.92 * linear).otherwise(1.055 * F.pow(linear, F.lit(1 / 2.4)) - 0.055)

    return F.array(*map(compand, TO_SRGB))


def bytes_needed(width: Column, height: Column, components: Column, bits: Column) -> Column:
    """Bytes of an image's samples: rows begin at bytes."""
    return (F.ceil(width.cast("long") * components * bits / 8) * height).cast("long")


#: Words of a font's name that tell its category, in the order they are tried (fixed values).
FONT_WORDS = (
    ("Cjk", ("mincho", "gothic", "明朝", "ゴシック", "song", "kai", "heiti", "batang", "dotum"), None),
    ("Monospace", ("courier", "mono", "consolas"), 1),
    ("Serif", ("times", "serif", "georgia", "palatino"), 2),
    ("Symbol", ("symbol", "dingbat", "wingdings"), 4),
)


def font_category(name: Column, flags: Column, cid_keyed: Column) -> Column:
    lower = F.lower(name)
    out = None
    for category, words, flag in FONT_WORDS:
        hit = lower.rlike("|".join(words)) | (cid_keyed if flag is None else (flags.bitwiseAND(F.lit(flag)) != 0))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("SansSerif")


def is_bold(name: Column) -> Column:
    return F.lower(name).rlike("bold|heavy|black|-w[6-9]")


def is_subset(name: Column) -> Column:
    return F.contains(name, F.lit("+"))
