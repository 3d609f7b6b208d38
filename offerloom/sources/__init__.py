"""Where offers come from: files, mails, sheets."""
