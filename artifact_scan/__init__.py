"""artifact_scan: batch auditing of agent instruction bundles on Spark."""
