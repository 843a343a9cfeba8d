"""DataFrame-to-DataFrame operators: profiles, keys, time, decision and scoring."""
