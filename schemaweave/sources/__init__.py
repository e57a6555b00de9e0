"""Where scripts come from and results go."""
