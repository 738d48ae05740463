"""Explicit schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T


def _s(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


EDGES = _s("src long, dst long")
NODES = _s("node_id long, group_id int")
RANKINGS = _s("ranking string, groups array<int>, strategies array<string>")
METHOD_RESULTS = _s("graph_name string, replicate_id int, ranking string, method string, node_id long, rank long, runtime double, value string")
SIR_LONG = _s("node_id long, group_id int, mean double, std double, num_simulations long")
SIR_SUMMARY = _s(
    "graph_name string, infection_prob double, num_simulations long, num_nodes long, num_nodes_evaluated long, mean_total double, median_total double,"
    " min_total double, max_total double, p25_total double, p75_total double, mean_pct double, median_pct double, min_pct double, max_pct double,"
    " p25_pct double, p75_pct double, avg_degree double, threshold_coefficient double, significance_pct double, num_significant long, significant_ratio double"
)
TIE_STATISTICS = _s(
    "variant string, component_index int, group_id int, infection_prob double, num_nodes_tied long, num_unique_vectors long, num_nodes long, fraction_tied double"
)
NODE_RANKS = _s(
    "node_id long, method string, ground_truth_rank long, method_rank long, sir_rank_snr long, graph_name string, ranking string, infection_prob double, n_nodes long"
)
PHI = _s("group_id int, share double")
