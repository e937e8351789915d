"""DataFrame-to-DataFrame operators: cleaning, extraction, clustering, evidence and cost."""
