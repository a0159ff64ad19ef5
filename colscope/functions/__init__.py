from colscope.functions.text import (
    canonical_text, fingerprint, norm_key, py_strip, truncate_text, name_variants, strip_code_fence,
)

__all__ = ["canonical_text", "fingerprint", "norm_key", "py_strip", "truncate_text", "name_variants",
           "strip_code_fence"]
