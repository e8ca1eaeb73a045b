"""Where tables live, how they are read and how they are written."""
