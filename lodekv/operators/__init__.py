"""DataFrame operators over logs, states, runs, rings and digests."""
