"""Query catalogue, oracle SQL and the step runner."""
