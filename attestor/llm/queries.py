"""The operators' registered queries and their DuckDB equivalents."""

from __future__ import annotations

from attestor.llm import decontamination, exact_dedup, hidden_markov, license_scan, line_dedup, merkle, mixing, near_dedup, periodic, repeats, secret_scan, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_secrets": secret_scan.op5_secrets,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_suffix_repeats": repeats.op8_suffix_repeats,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_hidden_markov": hidden_markov.op11_hidden_markov,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_merkle": merkle.op13_merkle,
}
SQL = {
    "op6_line_dedup": line_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op13_merkle": merkle.SQL,
}
