"""DataFrame-to-DataFrame operators: register arms, grounding checks and the decision diff."""
