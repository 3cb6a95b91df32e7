"""Reading corpora from files, and writing tokenised sets and reports."""
