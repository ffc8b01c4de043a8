"""The registered queries and the views they run over."""
