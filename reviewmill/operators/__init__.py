"""DataFrame operators that the job and report plans are built from."""
