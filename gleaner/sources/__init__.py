"""Where documents come from and where snapshots, scores and reports go."""
