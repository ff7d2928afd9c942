"""Column expressions shared by the operators. All JVM-side; no Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour (kept together, in natural order).
# ---------------------------------------------------------------------------------------------
STRUCTURAL_EDIT_LR_THRESHOLD = 0.6          # add/remove allowed when lr >= 0.6
VALID_ACTIONS = ("edit", "add", "remove")
NO_MODIFICATION = "NO_MODIFICATION"
DEFAULT_TARGET_SECTION = "Scoring Criteria"
FALLBACK_SCORE = 5.0
CLIP_SAMPLE_CHARS = 200                      # sample text clip, then "..."
CLIP_LOG_CHARS = 200                         # version-log summary / rationale clip, then "..."
CLIP_DIFF_CHARS = 100                        # section-diff preview clip, then "..."
# Score-extraction patterns, tried in this order; first match wins.
NUMBER = r"([0-9]*\.?[0-9]+)"
# Python's str-mode \s (str.isspace) written out, so Java and RE2 agree with it.
PY_SPACE = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
SCORE_PATTERNS = (
    r"(?:score|Score|SCORE)[" + PY_SPACE + r":：]*" + NUMBER,
    r"(?:分数|評分)[" + PY_SPACE + r":：]*" + NUMBER,
    r"(?:rating|Rating|RATING)[" + PY_SPACE + r":：]*" + NUMBER,
    r"(?md)^" + NUMBER + r"$",          # (?d): only \n ends a line, as in Python
    NUMBER,
)
# Fallback edit directions by mean error (> 0.1 stricter, < -0.1 more lenient, else keep).
FALLBACK_STRICTER = "评分标准应该更严格，降低高估倾向"
FALLBACK_LENIENT = "评分标准应该更宽松，降低低估倾向"
FALLBACK_KEEP = "保持当前评分标准，轻微调整以减少评分波动"
# Edit-strength tiers by lr / initial_lr: > 0.7 large, > 0.3 moderate, else slight.
STRENGTH_LARGE = "大幅度"
STRENGTH_MODERATE = "适度"
STRENGTH_SLIGHT = "轻微"
# Sample formatting (one line pair per sample; category placeholder when empty).
SAMPLE_FORMAT = "  样本%d: %s\n    人工评分: %s, AI评分: %s, 误差: %s\n"  # scores with 1 decimal, the error signed
EMPTY_CATEGORY_FORMAT = "  （无%s样本）\n"
CATEGORY_LABELS = {"overestimated": "高估", "underestimated": "低估", "well_aligned": "对齐"}
# Version-log message lines (values with 4 decimals; metric lines indented by two spaces).
VERSION_TITLE = "Step %d: Prompt optimization update"
VERSION_TRAIN_LOSS = "Train Loss: %s"
VERSION_VAL_LOSS = "Val Loss: %s"
VERSION_METRICS = "Metrics:"
VERSION_METRIC_LINE = "  %s: %s"
VERSION_SUMMARY = "Gradient Summary:"
VERSION_RATIONALE = "Modification Rationale:"
# ---------------------------------------------------------------------------------------------


#: The characters that ``str.strip()`` removes: all that Python calls whitespace (none lies above U+3000).
STRIP_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def clip_text(c: Column, n: int) -> Column:
    """First ``n`` characters plus ``...`` when longer, else unchanged."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace (linear in the text)."""
    return F.btrim(c, F.lit(STRIP_CHARS))


def md5_unit(*parts: Column | str) -> Column:
    """Deterministic uniform in (0, 1) from md5 of ``parts`` joined by ':' (same hex in SQL)."""
    s = F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    bits = F.conv(F.substring(s, 1, 8), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def md5_normal(*parts: Column | str) -> Column:
    """Standard normal by Box-Muller from two md5 uniforms (salted 'a' / 'b')."""
    u1 = md5_unit(*parts, F.lit("a"))
    u2 = md5_unit(*parts, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def round_half_up(c: Column, places: int) -> Column:
    """Round by floor(x * 10^p + 0.5) / 10^p: identical IEEE steps in every engine."""
    scale = float(10 ** places)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def huber(error: Column, delta: float = 1.0) -> Column:
    e = F.abs(error)
    return F.when(e <= F.lit(delta), F.lit(0.5) * e * e).otherwise(F.lit(delta) * (e - F.lit(0.5 * delta)))


def lr_at(index: Column, initial_lr: float | Column, min_lr: float | Column,
          max_steps: Column | int, warmup_steps: Column | int) -> Column:
    """Warm-up then cosine learning rate for schedule index ``index`` (0-based)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    i, hi, lo, m, w = lit(index).cast("double"), lit(initial_lr), lit(min_lr), lit(max_steps), lit(warmup_steps)
    warm = lo + (hi - lo) * F.try_divide(i, w.cast("double"))
    progress = F.when(m != w, F.least(F.try_divide(i - w, (m - w).cast("double")), F.lit(1.0)))  # least() skips NULL
    cosine = lo + (hi - lo) * (F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
    return F.when(i < w, warm).otherwise(cosine)


def can_structural_edit(lr: Column) -> Column:
    return lr >= F.lit(STRUCTURAL_EDIT_LR_THRESHOLD)


def strength_tier(lr: Column, initial_lr: float) -> Column:
    if initial_lr <= 0:
        raise ValueError(f"initial_lr must be positive, got {initial_lr}")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lr / F.lit(float(initial_lr))))
    return (F.when(ratio > 0.7, F.lit(STRENGTH_LARGE))
            .when(ratio > 0.3, F.lit(STRENGTH_MODERATE)).otherwise(F.lit(STRENGTH_SLIGHT)))


def extract_score(reply: Column) -> tuple[Column, Column]:
    """(score, used_fallback) for a judge reply: first matching pattern, else 5.0."""
    found = [F.nullif(F.regexp_extract(reply, p, 1), F.lit("")).try_cast("double")
             for p in SCORE_PATTERNS]
    score = F.coalesce(*found)
    return F.coalesce(score, F.lit(FALLBACK_SCORE)), score.isNull()
