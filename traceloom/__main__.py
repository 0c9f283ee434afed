from traceloom.cli import main

main()
