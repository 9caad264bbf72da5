"""Recorded decisions of the worked specification: what a replay must give again."""

#: Message, profile, hash of the input, SHA-256 of the journal's line.
JOURNAL = [
    ("stop the build", "standard", "b40e4993e961272c823caa1b074a1073a58466904937943ce45ce0e9e4b576e1", "74ac560ff34f1a298f74fca195b4fbbf983a98bf55d46beedafb131017ba5a32"),
    ("stpo now", "standard", "6cf3d23d81198ffe3a5b26e97855d5027f9e453dc5a8ab83c30c8e3a6706bb91", "b578d46ba8a92462932fa1f18317cbe8786208f9fda815d82e50e19a7be022f9"),
    ("don't stop", "standard", "a66ed428efa229293a76b214c8d6f8b2521bf3bab3ad6cf0bbb0ad8b201f07f3", "3c4b029285fa8033160b3d9699fca89866391903498eb801d4b8b5c9578862c9"),
    ("stop using postgres", "standard", "784d4b246f7c45bebb8846e3d4d4c9038b4790d103cf514c83dd22ef34f302d5", "afc84f21a29a39c30bb6fe89eb724e5378d5d7b804ff0a9cd4f4f1f8128544bd"),
    ("also add tests", "standard", "106697ea2e5b217ea746ec61046fedc77fcd32beb8903e8bece309c646b8ac35", "d37255d2a0dd3452b22596927a295027ec6d25bde83c3ad1b7023c890e3459d7"),
    ("use rust instead", "standard", "0aa6d00b3b608dc8a6a63bd10b9be36bc254c16ece991c29fb2beb1c9597f5db", "168f299155e434711a956f9b95a2472a35aad9ed8ec0c36bec0d1a645006298b"),
    ("run `stop` now", "standard", "90d83e5b40630fab74e22e0e5972b400bebc680697cdad85aa2f4ca8216f81b6", "c924f860bc90393314d35999779b3a0296087bc95721df2c5a115b7a0de77170"),
    ("ѕtop the build", "standard", "af93a62ff6e6374e6ee0c2f70459ab26bd3a45459874abe7798d6550d17393b9", "6ff34d765fe80ebbbed80ce3b2f73f8b35e11a5b41b8c63601d1d637486fedee"),
    ("should I stop?", "standard", "673b96ca30598b879af8cc1b7d80ba3c382cd219e72198813f494ba887133550", "be749fc407a1cb9362c33927eae134e59489671626e91f696f7f240acc1c76f0"),
    ("hello there", "fast", "dca43170d57149fc5c7625674b92d304a05f59cdb4f99fb05d59e825ded3573d", "18ade230fb84e90f375684fbf6be8f4738552cd0f1ae3cf2fd57beb7f4d6f21c"),
    ("cancel the job", "deep", "de555c7ee8290b7aa6bf45ec292e735cea5452eb55cb072dc55723cf09aaf4cd", "e6c309881d30e7608484b629aac0b367c736f48bd39594bd559038006515cfbc"),
    ("STOP!!", "standard", "e6d90b87f8bb8da890f18b26ad5072e5e37218124ff313227edaef5508cf6ac7", "dc18310e1cd2d01411b9ec27db8eb1e69d973f654c571967ba2b8f6f3b60328c"),
]
