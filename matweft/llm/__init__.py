"""Training-data operators: dedup, decontamination, scoring, filtering, mixing."""
