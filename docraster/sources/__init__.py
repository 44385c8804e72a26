"""Where page tables come from and go to."""
