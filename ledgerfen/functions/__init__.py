"""Part of the ledgerfen engine."""
