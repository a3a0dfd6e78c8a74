"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe import op13_byte_pair_encoding
from .chat_format import OP5_SQL, op5_chat_formatting
from .decontamination import op6_benchmark_decontamination
from .fill_middle import OP12_SQL, op12_fill_in_middle
from .jaccard_join import op9_ngram_jaccard_join
from .language_id import op4_language_id
from .licenses import op3_license_scan
from .line_dedup import op7_line_dedup
from .mixing import OP2_SQL, op2_source_mixing
from .quality import op8_quality_classifier
from .repair import OP11_SQL, op11_structure_repair
from .secrets import op1_secret_scan
from .vector_search import op10_vector_search

_QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_source_mixing,
        op3_license_scan,
        op4_language_id,
        op5_chat_formatting,
        op6_benchmark_decontamination,
        op7_line_dedup,
        op8_quality_classifier,
        op9_ngram_jaccard_join,
        op10_vector_search,
        op11_structure_repair,
        op12_fill_in_middle,
        op13_byte_pair_encoding,
    )
}

_SQL = {"op2_source_mixing": OP2_SQL, "op5_chat_formatting": OP5_SQL, "op11_structure_repair": OP11_SQL, "op12_fill_in_middle": OP12_SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_SQL)
