"""Where sales lines come from and results go to."""
