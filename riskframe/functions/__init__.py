from .columns import (decision_expr, decision_code_expr, band_expr, safe_div, r6,
                      finite_or_null, BAND_PRESETS)

__all__ = ["decision_expr", "decision_code_expr", "band_expr", "safe_div", "r6",
           "finite_or_null", "BAND_PRESETS"]
