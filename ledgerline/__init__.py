"""ledgerline: an auditable statement ledger and text-analytics engine on PySpark."""
