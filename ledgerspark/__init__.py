"""Personal-finance ledgers as Spark jobs: ingest, reconcile, detect, project, report."""
