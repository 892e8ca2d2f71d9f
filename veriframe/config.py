"""Options of the verification engine; zero means unset, so the default holds."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Fixed values.
RADIUS, NUMERIC_RADIUS = 0.14, 0.12
TIE_MARGIN = 0.15
MIN_CONFIDENCE = 0.5
CONFUSION_COST = 0.5
MAX_SIDE, BOX_THRESHOLD, UNCLIP, TURNED, SECOND_OPINION = 1600.0, 0.3, 1.6, 1.0, 0.0
SCORE_THRESHOLD, MIN_SIDE = 0.5, 3
MAX_RUN = MAX_FOLLOW = 4
MAX_REFERENCE_RUN, FOUND_ENOUGH, SEED_GATE = 14, 0.5, 0.5
EMPHASIS_CONTRAST, INLINE_GATE, WORD_GATE, BAND = 1.15, 0.35, 0.34, 6
ABV_STEP, BEER_STEP, ABV_MOST, ABV_TOLERANCE, NET_TOLERANCE = 0.5, 0.1, 95.0, 0.05, 5.0
ML_PER_FL_OZ = 29.5735

STATUSES = ("VERIFIED", "MISMATCH", "REVIEW", "NOT_FOUND", "SKIPPED")


@dataclass(frozen=True)
class Options:
    radius: float = RADIUS
    numeric_radius: float = NUMERIC_RADIUS
    tie_margin: float = TIE_MARGIN
    min_confidence: float = MIN_CONFIDENCE
    confusion_cost: float = CONFUSION_COST
    max_side: float = MAX_SIDE
    box_threshold: float = BOX_THRESHOLD
    unclip: float = UNCLIP
    turned: float = TURNED
    second_opinion: float = SECOND_OPINION

    @property
    def half_cost(self) -> int:
        """What a confusable substitution costs in half edits, 0 to 2."""
        return min(2, max(0, round(2 * self.confusion_cost)))

    def tuned(self, overrides: dict[str, float]) -> Options:
        """With named overrides; a zero leaves the value, an unknown name is an error."""
        known = {f.name for f in fields(self)}
        if odd := set(overrides) - known:
            raise ValueError(f"unknown options: {', '.join(sorted(odd))}")
        return replace(self, **{k: float(v) for k, v in overrides.items() if v})


DEFAULT = Options()
