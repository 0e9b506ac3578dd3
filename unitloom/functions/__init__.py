from .arrays import slice_at, start_offsets
from .hashing import HASH_SPAN, coin, hash01, id_hash
from .metrics import (
    bits_per_byte,
    first_target,
    boundary_weight,
    gold_index,
    log_sum_exp,
    ratio,
    stderr,
    weighted_mean,
)
from .text import (
    RUNS,
    CORE,
    WORD_NEXT,
    WORD_PREV,
    byte_levenshtein,
    byte_text,
    canonical_form,
    char_units,
    chop_bytes,
    chunk_chars,
    n_bytes,
    unit_type,
)

__all__ = [name for name in dir() if not name.startswith("_")]
