"""Where report inputs come from and where report datasets go."""
