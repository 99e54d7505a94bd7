"""Full-text index as two DataFrames: postings and document lengths."""
