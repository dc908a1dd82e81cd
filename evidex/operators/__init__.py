"""DataFrame operators; each module states its edge cases."""
