"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chosen_path, decontam, filter_audit, line_frequency
from .chosen_path import op5_ngram_jaccard
from .decontam import op10_decontaminate
from .filter_audit import op11_filter_audit
from .hmm_lm import op3_hmm_score
from .lang_bitmask import op6_language_id
from .license_rules import op8_license_scan
from .line_frequency import op9_quality_rules
from .mixing import op7_mix_sources
from .periodic_runs import op12_periodic_runs
from .pfp_dedup import op2_remove_repeats
from .pii_feistel import op4_pseudonymise
from .rff_quality import op13_quality_score
from .secrets_markov import op1_secret_scan

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_remove_repeats": op2_remove_repeats,
    "op3_hmm_score": op3_hmm_score,
    "op4_pseudonymise": op4_pseudonymise,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_score": op13_quality_score,
}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": chosen_path.ORACLE,
    "op9_quality_rules": line_frequency.ORACLE,
    "op10_decontaminate": decontam.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
}
