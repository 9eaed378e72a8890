"""ledgerline: statement and usage analytics as Spark jobs."""
