"""Sources and sinks: catalog CSV, load ledger, light-curve products, result tables."""
