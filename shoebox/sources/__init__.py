"""Where bytes and tables come from and go to."""
