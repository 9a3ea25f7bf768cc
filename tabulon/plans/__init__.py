"""Formula language: text to syntax tree to Catalyst columns."""
