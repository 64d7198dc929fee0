from gapwright.cli import main

main()
