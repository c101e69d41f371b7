from callsheet.functions.columns import (binarize, col_of, recode, rounded, safe_div, seeded_hash,
                                         stars, yes_no)

__all__ = ["binarize", "col_of", "recode", "rounded", "safe_div", "seeded_hash", "stars", "yes_no"]
