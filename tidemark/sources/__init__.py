"""Reading and writing stores."""
