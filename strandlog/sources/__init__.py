"""Where event logs come from and where they go."""
